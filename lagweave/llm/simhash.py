"""Near duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r every bit position i gets a nonzero vector phi(i) of r+1 bits, and every nonzero
vector t gives a table whose mask holds the positions with odd <phi(i), t>. The vectors of at most r differing positions
span at most r dimensions, so some t is orthogonal to all of them: its mask avoids every differing bit, and the pair has
equal keys there. So each pair within the radius meets in one of the 2^(r+1) - 1 tables, with certainty.

Fingerprints are reduced to distinct ones first. A bucket of up to `bucket` fingerprints is compared in one task; it
gives a spanning forest of its links, not all pairs. Larger buckets are split by a second covering over the bits outside
the first mask, which keeps the guarantee; a second-level bucket can hold 2^16 distinct fingerprints at most, as so few
bits are left free. So no bucket is capped and no group is unbounded.

Defined cases: NULL and empty texts have no words and fingerprint zero, and link like any other. Texts of fewer words than
a shingle are one shingle. A NULL id takes the component of its fingerprint, which is NULL if no id has it. Repeated rows share a
fingerprint. An empty table gives no rows. Further columns are ignored by `near_components` and kept by `keep_one`.
"""

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import stored
from .common import keep_rows, map_batches, text_of, utf8
from .components import components

BITS = 64
WORDS = 3
RADIUS = 3
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    import xxhash

    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    n, ones = len(found) - words + 1, np.zeros(BITS, np.int64)
    for start in range(0, n, BLOCK):
        part = found[start : start + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(words)]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batch: pa.RecordBatch, words: int, seed: int) -> pa.RecordBatch:
    found = np.array([fingerprint(t, words, seed) for t in utf8(batch, "_text")], np.uint64)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["_id", "_content", "_fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: (_id, _content, _fp), the latter a signed long, `_content` a hash of the text."""
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.xxhash64(text_of(text_column)).alias("_content"), text_of(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows, partial(_fingerprints, words=words, seed=seed), f"_id {kind}, _content bigint, _fp bigint")


def masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """The covering masks over the given bit positions, as unsigned numbers."""
    positions, top = list(range(BITS)) if positions is None else positions, 1 << (radius + 1)
    vectors = {p: k % (top - 1) + 1 for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vectors[p] & t).bit_count() & 1) for t in range(1, top)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the radius among distinct fingerprints."""
    left, right, rest = [], [], points
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            nearest = np.full(len(rest), -1)
            for start in range(0, len(front), 256):  # bounded blocks
                close = np.bitwise_count(front[start : start + 256, None] ^ rest[None, :]) <= radius
                hit = close.any(axis=0) & (nearest < 0)
                nearest[hit] = start + close[:, hit].argmax(axis=0)
            new = nearest >= 0
            left.append(front[nearest[new]])
            right.append(rest[new])
            front, rest = rest[new], rest[~new]
    none = np.empty(0, points.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _bucket_links(batch: pa.RecordBatch, radius: int) -> pa.RecordBatch | None:
    lists = batch.column(0)
    values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    found = [_forest(values[a:b], radius) for a, b in zip(ends[:-1], ends[1:])]
    left, right = (np.concatenate(side).view(np.int64) for side in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"]) if len(left) else None


def _keyed(points: DataFrame, columns: list[str], chosen: list[int]) -> DataFrame:
    keys = F.array(*[F.col("_fp").bitwiseAND(F.lit(_signed(m))) for m in chosen])
    return points.select(*columns, "_fp", F.posexplode(keys).alias("_t", "_key"))


def links(points: DataFrame, radius: int = RADIUS, bucket: int = 256) -> DataFrame:
    """(a, b): links between distinct fingerprints `_fp` that keep every two of them within the radius connected."""
    first = masks(radius)
    keyed = _keyed(points, [], first)
    sizes = keyed.groupBy("_t", "_key").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = keyed.join(sizes, ["_t", "_key"])
    small = shared.where(F.col("_n") <= bucket).groupBy("_t", "_key").agg(F.collect_list("_fp").alias("_fps"))
    # Second level: the bits outside the first mask, with one covering per first table.
    rest = [masks(radius, [p for p in range(BITS) if not m >> p & 1]) for m in first]
    second = F.array(*[F.array(*[F.lit(_signed(m)) for m in of_table]) for of_table in rest])
    large = shared.where(F.col("_n") > bucket).select(
        "_t", "_key", "_fp", F.posexplode(F.transform(second[F.col("_t")], lambda m: F.col("_fp").bitwiseAND(m))).alias("_t2", "_key2")
    )
    split = large.groupBy("_t", "_key", "_t2", "_key2").agg(F.collect_list("_fp").alias("_fps")).where(F.size("_fps") > 1)
    lists = small.select("_fps").union(split.select("_fps"))
    return map_batches(lists, partial(_bucket_links, radius=radius), "a bigint, b bigint")


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """(_fp, _root, component_id) for every distinct fingerprint."""
    points = stored(rows.groupBy("_fp").agg(F.min("_id").alias("_low")), "fingerprints")
    roots = components(links(points, radius))
    rooted = points.join(roots, points["_fp"] == roots["node"], "left").select(
        "_fp", "_low", F.coalesce("root", "_fp").alias("_root")
    )
    lowest = rooted.groupBy("_root").agg(F.min("_low").alias("component_id"))
    return rooted.select("_fp", "_root").join(lowest, "_root")


def near_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """One row per row of `docs`: (id, fingerprint, component_id), the smallest id reachable over links."""
    rows = stored(fingerprints(docs, id_column, text_column, words, seed), "simhash")
    joined = rows.join(_labelled(rows, radius), "_fp")
    return joined.select(F.col("_id").alias(id_column), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """The rows of `docs`, one of each component: that with the smallest id."""
    rows = stored(fingerprints(docs, id_column, text_column, words, seed), "simhash")
    member = rows.join(_labelled(rows, radius).select("_fp", "_root"), "_fp")
    # NULL ids come last.
    chosen = member.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_content")).alias("_first"))
    kept = chosen.select("_first._id", "_first._content")
    return keep_rows(docs, [("_id", F.col(f"`{id_column}`")), ("_content", F.xxhash64(text_of(text_column)))], kept)
