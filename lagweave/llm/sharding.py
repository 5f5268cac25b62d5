"""Shards of near equal size that keep equal texts together: minimax contiguous partition.

Groups of equal texts are the atoms, in the order of their smallest id. The capacity of a shard is the smallest for which
cutting greedily, each shard taking groups while they fit, needs no more than the given number of shards; a search over the
capacity finds it, and the greedy cuts at that capacity are the result. No contiguous partition has a smaller largest shard.

Everything is built-in expressions. A global order is made by ranges of (group, id), so a group that holds a third of the
rows is spread over several ranges; positions within a range and totals of the ranges before it give global prefix sums.
The binary search runs on a bounded sketch of the group ends: per bin the first and the last. A check that trusts only known
ends gives an upper bound, one that hopes for an end anywhere in a bin a lower bound; the spans where they may part are read
again in finer bins, until the cuts are exact. That takes a few passes over one row per group, whatever their number.

Defined cases: a NULL text has no bytes, its checksum is 0 and it groups with empty texts. A group's place is that of its
smallest id, NULL ids first. Rows that repeat id and text take neighbouring slots. An empty table gives no rows. If one group is larger
than an even share, it sets the capacity. Shards beyond the last group are empty. Further columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import stored
from .common import text_of

PLACE = ("_first", "_group", "_id", "_crc")


def _ordered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows with global prefix sums: (_id, _size, _crc, _first, _group, _end, _row)."""
    text = text_of(text_column)
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("_size"),
        F.crc32(text).alias("_crc"),
        F.unhex(F.sha2(text, 256)).alias("_group"),
    )
    firsts = rows.groupBy("_group").agg(F.min("_id").alias("_first"))
    # The ranges are sampled, so the dealt rows are written: later steps see the same ones.
    ranged = rows.join(firsts, "_group").repartitionByRange(*PLACE[:3]).withColumn("_part", F.spark_partition_id())
    rows = stored(ranged, "ranges")
    totals = rows.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0")
    )
    own = Window.partitionBy("_part").orderBy(*PLACE)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"_end": F.sum("_size").over(upto), "_row": F.row_number().over(own).cast("bigint")})
    placed = placed.join(F.broadcast(offsets), "_part")  # as many rows as there are ranges
    return placed.select("_id", "_size", "_crc", "_first", "_group", (F.col("_end") + F.col("_b0")).alias("_end"), (F.col("_row") + F.col("_r0")).alias("_row"))


class _Ends:
    """What the driver knows of the group ends: some of them in order, and after which of them there may be others."""

    def __init__(self, total: int, rows: int):
        self.known = {0: (0, False), total: (rows, True)}  # end: (rows up to it, no other end before the next known one)
        self._sort()

    def _sort(self) -> None:
        self.ends = np.array(sorted(self.known))
        self.whole = np.array([self.known[e][1] for e in self.ends.tolist()])

    def _at(self, x: int) -> int:
        return int(np.searchsorted(self.ends, x, "right")) - 1

    def path(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy cuts. Where the last end up to x may be an unknown one: the known one before or, if `hopeful`, x itself."""
        cuts = [0]
        for _ in range(shards):
            x = cuts[-1] + capacity
            i = self._at(x)
            cuts.append(x if hopeful and not self.whole[i] else int(self.ends[i]))
        return cuts

    def smallest(self, shards: int, hopeful: bool, low: int, high: int) -> int:
        """Binary search for the smallest feasible capacity, by the greedy check."""
        while low < high:
            middle = (low + high) // 2
            if self.path(middle, shards, hopeful)[-1] >= self.ends[-1]:
                high = middle
            else:
                low = middle + 1
        return low

    def unknown(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """The spans, between known ends, where a greedy fill at `low` to `high` may meet unknown ends."""
        spans: list[tuple[int, int]] = []
        for a, b in zip(self.path(low, shards, False)[:-1], self.path(high, shards, True)[:-1]):
            i, j = self._at(a + low), min(self._at(b + high) + 1, len(self.ends) - 1)
            gaps = np.flatnonzero(~self.whole[i:j])
            if len(gaps):
                start, stop = int(self.ends[i + gaps[0]]), int(self.ends[i + gaps[-1] + 1])
                if spans and start < spans[-1][1]:
                    start, stop = spans[-1][0], max(stop, spans.pop()[1])
                spans.append((start, stop))
        return spans

    def learn(self, ends: DataFrame, spans: list[tuple[int, int]], bins: int) -> None:
        """Of every bin of the spans the first and last end and their number: at most `bins` rows come to the driver."""
        place, width = F.lit(None).cast("bigint"), bins // len(spans)
        for k, (a, b) in enumerate(spans):
            step = -(-(b - a) // width)
            inside = (F.col("_end") > a) & (F.col("_end") < b)
            place = F.when(inside, F.floor((F.col("_end") - a) / F.lit(step)) + k * width).otherwise(place)
            self.known = {e: v for e, v in self.known.items() if not a < e < b}  # read again, in finer bins
            self.known[a] = self.known[a][0], True
        both = F.struct("_end", "_row")
        found = ends.groupBy(place.alias("_bin")).agg(F.min(both).alias("low"), F.max(both).alias("high"), F.count("*").alias("n"))
        for row in found.where("_bin IS NOT NULL").collect():
            self.known[row["low"][0]] = row["low"][1], row["n"] <= 2
            self.known[row["high"][0]] = row["high"][1], True
        self._sort()


def minimax_cuts(ends: DataFrame, shards: int, total: int, rows: int, largest: int, bins: int = 1 << 16) -> list[tuple[int, int]]:
    """The (bytes, rows) where each shard ends, at the smallest feasible capacity.

    `ends` has one row per group: (_end, _row), bytes and rows up to its last row.
    """
    known = _Ends(total, rows)
    low, high = max(largest, -(-total // shards)), total
    while True:
        low, high = known.smallest(shards, True, low, high), known.smallest(shards, False, low, high)
        spans = known.unknown(low, high, shards)
        if not spans:  # then both bounds have met
            return [(cut, known.known[cut][0]) for cut in known.path(high, shards, False)[1:]]
        known.learn(ends, spans, bins)


def shard_rows(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, size, text_crc32, law, shard, slot, grown_shard), for the law of equal bytes."""
    rows = stored(_ordered(docs, id_column, text_column), "ordered")
    groups = rows.groupBy("_first", "_group").agg(F.max("_end").alias("_end"), F.max("_row").alias("_row"), F.sum("_size").alias("_size"))
    ends = stored(groups.drop("_first", "_group"), "ends")
    total, n, largest = ends.agg(F.max("_end"), F.max("_row"), F.max("_size")).first()
    cuts = minimax_cuts(ends, shards, total, n, largest) if total else []
    shard, before = F.lit(0), F.lit(0).cast("bigint")
    for end, row in cuts[:-1]:
        beyond = F.col("_end") > end
        shard = shard + beyond.cast("int")
        before = F.when(beyond, F.lit(row).cast("bigint")).otherwise(before)
    return rows.select(
        F.col("_id").alias(id_column),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        shard.alias("shard"),
        (F.col("_row") - 1 - before).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
