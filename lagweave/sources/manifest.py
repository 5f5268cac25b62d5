"""What a stored table was made from: a manifest, written last, is the mark that the table is complete.

A manifest names the input files with sizes and times, the parameters, the columns, the number of rows, and the files of the table itself. A table without a
manifest is the rest of a run that was lost; one whose manifest says something else is stale, and one whose files are not those of the manifest is
damaged. None of them is taken for present. The rows are counted by the write itself.
"""

import json
from collections.abc import Iterable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

NAME = "_manifest.json"  # readers pass over names with an underscore


def _place(spark: SparkSession, path: str):
    """(file system, path) in the terms of Hadoop, for any store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, name, length, changed) of the data files below some folders or at some paths; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    name = F.regexp_extract("path", "[^/]+$", 0)
    return found.select("path", name.alias("name"), "length", F.unix_micros("modificationTime").alias("changed"))


def digest(files: DataFrame, columns: Sequence[str]) -> dict:
    """Number, bytes and digest of a list of files: one row, for any number of them."""
    hashed = F.xxhash64(*columns)
    row = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.bit_xor(hashed), F.sum(F.shiftrightunsigned(hashed, 28))).first()
    return {"files": row[0], "bytes": row[1], "digest": [row[2], row[3]]}


def files_read(df: DataFrame) -> set[str]:
    """The files that `df` is written down to read, also where a filter shows that no row of them is needed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.update(leaf.relation().location().inputFiles())
    return found


def describe(df: DataFrame, parameters: Mapping | None = None, inputs: Iterable[str] | None = None) -> dict:
    """What a table made from `df` has to say of its origin. `inputs` are folders or files, by default those that `df` reads."""
    spark = df.sparkSession
    paths = sorted(files_read(df) if inputs is None else set(inputs))
    read = digest(list_files(spark, paths), ("path", "length", "changed")) if paths else None
    known = json.loads(json.dumps(dict(parameters or {}), default=str))
    return {"inputs": read, "parameters": known, "columns": [list(c) for c in df.dtypes]}


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    system, target = _place(spark, f"{path}/{NAME}")
    if not system.exists(target):
        return None
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(system.open(target), "UTF-8"))
    try:
        return json.loads(reader.readLine())
    except (TypeError, ValueError, Py4JJavaError):  # an empty, cut or unreadable file
        return None
    finally:
        reader.close()


def write_manifest(spark: SparkSession, path: str, origin: Mapping, rows: int) -> None:
    """Written under another name first, so that a manifest is whole or absent."""
    said = json.dumps({**origin, "rows": rows, "table": _table(spark, path)}, sort_keys=True)
    system, target = _place(spark, f"{path}/{NAME}")
    _, draft = _place(spark, f"{path}/{NAME}.draft")
    stream = system.create(draft, True)
    stream.write(bytearray(said.encode()))
    stream.close()
    system.delete(target, False)
    if not system.rename(draft, target):
        raise OSError(f"cannot write the manifest of {path}")


def _table(spark: SparkSession, path: str) -> dict:
    """A table's own files by name and size, so that it may be moved; the writer gives every file a name of its own."""
    return digest(list_files(spark, [path]), ("name", "length"))


def state_of(spark: SparkSession, path: str, origin: Mapping) -> str:
    """'absent', 'broken' (no manifest), 'stale' (made from something else), 'damaged' (other files) or 'present'."""
    system, target = _place(spark, path)
    if not system.exists(target):
        return "absent"
    found = read_manifest(spark, path)
    if found is None:
        return "broken"
    if any(found.get(k) != v for k, v in origin.items()):
        return "stale"
    return "present" if found.get("table") == _table(spark, path) else "damaged"
