"""Quality by compression: zstandard with a dictionary of good and one of bad labelled text.

A text is first reduced to its shape, window by window of `WINDOW` words: runs of letters become one sign (capitals two), digits a 9, a
word that repeats its predecessor an equals sign; punctuation and white space stay. Each window is compressed by itself with
either dictionary, so that a long text cannot teach the compressor its own habits. With the sizes summed over the whole
text, x = (bad - good) / (good + bad) is the normalised difference. A logistic curve fitted on labelled rows that did not go
into the dictionaries turns it into a probability; its second term, which falls with good + bad, says how much a
difference near zero means in a text of that size.

Learning uses a bounded sample: at most `sample` labelled rows, by hash of their id, every second one for the dictionaries
(at most `WINDOWS` windows each) and the others for the curve. What reaches the driver is bounded by these numbers.

Defined cases: NULL and empty texts have x = 0 and size 0 and get the score of that. Labels that are NULL, or whose id is NULL or not
in `docs`, teach nothing. Where one class has no labelled row, every score is 1.0 if only good ones or none are known, and 0.0 if
only bad ones are. Repeated rows get equal scores. An empty table gives no rows. Further columns do not matter.
"""

import re
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import stored
from .common import map_batches, ship, text_of

WINDOW = 32
WINDOWS = 24
SAMPLE = 6000
DICTIONARY = 4000
LEVEL = 9
CUT = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # of the difference, of shortness, and the offset


def _signs() -> bytes:
    signs = bytearray(range(256))
    signs[0x80:] = b"a" * 128  # the bytes of letters beyond ASCII
    signs[ord("a") : ord("z") + 1] = b"a" * 26
    signs[ord("A") : ord("Z") + 1] = b"A" * 26
    signs[ord("0") : ord("9") + 1] = b"9" * 10
    return bytes(signs)


SIGNS, LETTERS, CAPITALS = _signs(), re.compile(rb"a{2,}"), re.compile(rb"A{2,}")


def shapes(text: bytes, window: int = WINDOW) -> list[bytes]:
    """The shape of every window of a UTF-8 text."""
    words = text.replace(b"\n", b" \n ").split(b" ")
    marked = words[:1] + [b"=" if a == b else b for a, b in zip(words, words[1:])]
    parts = [b" ".join(marked[k : k + window]).translate(SIGNS) for k in range(0, len(marked), window)]
    return [CAPITALS.sub(b"AA", LETTERS.sub(b"a", p)) for p in parts]


@cache
def _compressors(good: bytes, bad: bytes) -> tuple:
    import zstandard

    made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (good, bad)]
    for each in made:
        each.precompute_compress(level=LEVEL)
    plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    return tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **plain) for d in made)


FRAME = 6  # bytes of a frame around any content
SHORT = 32


def features(text: bytes, model: Model) -> tuple[float, float]:
    """The normalised difference of the compressed sizes, high if the text looks like the good ones, and its shortness."""
    good, bad = _compressors(model.good, model.bad)
    a = b = 0
    for part in shapes(text):
        a += len(good.compress(part)) - FRAME
        b += len(bad.compress(part)) - FRAME
    size = max(a + b, 1)
    return (b - a) / size, 1 / (1 + size / SHORT)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in texts.to_pylist()]


def score_column(model: Model, text_column: str = "text") -> Column:
    """The score of the text as a column expression over whole texts."""

    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(t, model) for t in _bytes(texts)], float).reshape(-1, 2)
        logit = x @ np.array(model.weights[:2]) + model.weights[2]
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return F.arrow_udf(score, "double")(text_of(text_column))


def _windows(batch: pa.RecordBatch, limit: int) -> pa.RecordBatch:
    labels, out, parts = batch.column(1).to_pylist(), [], []
    for label, text in zip(labels, _bytes(batch.column(0))):
        found = shapes(text)
        chosen = found[:: max(1, -(-len(found) // limit))]
        parts += chosen
        out += [label] * len(chosen)
    return pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(parts, pa.binary())], ["label", "part"])


def _dictionary(parts: list[bytes], size: int, seed: int = 7) -> bytes:
    """Windows in random order up to the size. Of equal ones the last counts, so the order is one of distinct windows."""
    distinct = sorted(set(parts))
    order = np.random.default_rng(seed).permutation(len(distinct))
    return b"\n".join(distinct[i] for i in order)[:size]


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression of y on the columns of x by Newton steps, with a slight ridge for data that a cut separates."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([x / scale, np.ones(len(x))])
    w, eye = np.zeros(design.shape[1]), np.eye(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * eye, design.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale).tolist(), float(w[-1]))


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Dictionaries and curve from the labelled rows of `docs` that are not held out."""
    known = labels.select(F.col(id_column).alias("_lid"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_lid").isNotNull() & F.col("_label").isNotNull() & ~held_out("_lid")).distinct()
    order = F.xxhash64("_lid", F.lit(9))
    chosen = known.withColumn("_order", order).orderBy("_order", "_lid", "_label").limit(sample)
    chosen = chosen.withColumn("_fold", F.pmod(F.xxhash64("_lid", F.lit(10)), F.lit(2)))
    rows = docs.select(F.col(f"`{id_column}`").alias("_lid"), text_of(text_column).alias("_text"))
    # At most `sample` ids: a bounded broadcast.
    rows = stored(rows.join(F.broadcast(chosen), "_lid").select("_text", "_label", "_fold"), "labelled")
    seen = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not seen.get(1) or not seen.get(0):
        return Model(b"", b"", (0.0, 0.0, -30.0 if seen.get(0) else 30.0))
    parts = map_batches(rows.where("_fold = 0").select("_text", "_label"), partial(_windows, limit=WINDOWS), "label int, part binary")
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for row in parts.collect():
        found.setdefault(row["label"], []).append(bytes(row["part"]))
    draft = Model(_dictionary(found[1], DICTIONARY), _dictionary(found[0], DICTIONARY), (1.0, 0.0, 0.0))
    ship(docs.sparkSession)
    measured = rows.where("_fold = 1 AND _label IN (0, 1)").select("_label", _feature_column(draft).alias("x")).collect()
    y = np.array([r["_label"] for r in measured], float)
    if len(set(y)) < 2:
        return Model(draft.good, draft.bad, (0.0, 0.0, 30.0 if seen[1] >= seen[0] else -30.0))
    return Model(draft.good, draft.bad, _curve(np.array([r["x"] for r in measured]), y))


def _feature_column(model: Model) -> Column:
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, model) for t in _bytes(texts)], pa.list_(pa.float64()))

    return F.arrow_udf(measure, "array<double>")(F.col("_text"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: float = CUT) -> DataFrame:
    """One row per row of `docs`: (id, held_out, score, predicted)."""
    model = fit(docs, labels, id_column, text_column)
    scored = docs.select(F.col(f"`{id_column}`"), held_out(id_column).alias("held_out"), score_column(model, text_column).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of `docs` whose score reaches the cut."""
    model = fit(docs, labels, id_column, text_column)
    ship(docs.sparkSession)
    return docs.where(score_column(model, text_column) >= cut)
