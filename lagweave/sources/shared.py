"""Where intermediate tables go."""

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Bytecode of a method beyond which HotSpot leaves it to the interpreter.
METHOD_LIMIT = "8000"


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    The one the session names in `spark.checkpoint.dir`; where none is set in a local session, one below the warehouse. A cluster
    has to name one, as the warehouse may be a folder that only the driver sees.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lagweave-scratch"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: later uses see one result, also after a lost executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table below the shared folder that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    target = place(path)
    if not target.toUri().getPath().startswith(place(shared_folder(spark)).toUri().getPath() + "/"):
        raise ValueError(f"not below the shared folder: {path}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def open_writers(spark: SparkSession, n: int) -> Iterator[None]:
    """Writes inside keep up to n folders of a table open in a task; by default a task sorts all its rows by folder first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def compiled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query in whose session no generated method is too long for HotSpot to compile.

    By default Spark runs whole stages as one method up to 64 KB, which then is interpreted. Wide rows, a dozen scaled lags or a few trees are enough
    for that. Beyond the limit a stage runs operator by operator, whose code is cut into short methods.
    """

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
        return query(spark, folder)

    return run
