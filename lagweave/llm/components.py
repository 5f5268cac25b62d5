"""Connected components of a link table by alternating star contraction.

Every round is a few joins and map-side combined minima over links; nothing but a count and a checksum per round reaches
the driver. Each round's links are written to the shared folder, which cuts the lineage.
"""

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link to another one.

    Links may repeat, point either way or link a node to itself; NULL ends are no links. An empty table gives no rows.
    """
    x, y = F.col(a), F.col(b)
    now = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now, before = stored(now, "links"), None
    while (state := _state(now)) != before:
        now, before = stored(_small_star(_large_star(now)), "links"), state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _lowest(links: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u's neighbours and u itself. A hub's rows stay in the join, which Spark can split."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    near = _lowest(links)
    moved = near.select("v", "m").where("v > m").union(near.select("u", "m"))
    return moved.toDF("u", "v").distinct()
