"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct words, their beginnings of 4 to 6 letters, and the shorter ones of these with the number of letters
that follow. The model has one weight per feature and an
ascending threshold per step between grades: P(grade > k) = logistic(w.x - t_k), the weights being shared by all
thresholds. The expected severity is the sum of these over k.

Labels say toxic or not. Grades follow in two steps: a first fit, with one threshold, tells which features are toxic; labelled toxic
texts are then severe (2) where the share of their words with such features is above the median, else mild (1), and others 0. With these
grades the model is fitted again.

Learning uses a bounded sample: at most `sample` labelled rows by hash of their id, a quarter of them toxic at most; their
distinct words come to the driver. Every fifth row is kept out of the fit and sets the cut from which a text counts as
toxic: the probability that gives the best F there, precision and recall counting alike.
Scoring reads whole texts, in one pass and without a shuffle.

Defined cases: NULL and empty texts have no features and get the score of that. Labels that are NULL, or whose id is NULL or not in
`docs`, teach nothing. Without labelled rows of both kinds every severity is 0, or 1 if all are toxic. Repeated rows get equal scores. An
empty table gives no rows. Further columns are ignored.
"""

import re
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, text_of, utf8

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 4000
SEEN = 3
APART = 4.0
CACHED = 300_000
LONGEST = 40


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]
    cut: float = 0.5


def words_of(text: bytes) -> list[str]:
    return sorted(set(WORD.findall(text.decode("utf-8", "replace").lower())))


def features_of(word: str) -> list[str]:
    starts = [f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k]
    return [word[:LONGEST], *starts, *[f"{word[:k]}+{min(len(word) - k, 9)}" for k in (4, 5) if len(word) > k]]


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, ridge: float = 0.5, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for grades 0..K and presence features given as (row, column) pairs; gradient steps with momentum.

    The likelihood is that of the K steps, "grade over k or not", each a logistic with shared weights; thresholds stay in order.
    """
    top, n = int(grades.max()), len(grades)
    over = grades[:, None] > np.arange(top)
    share = np.clip(over.mean(axis=0), 1e-4, 1 - 1e-4)
    w, thresholds = np.zeros(width), np.log(1 / share - 1)
    # Diagonal scaling: a feature's curvature is bounded by a quarter of its row count and steps.
    degree = np.bincount(columns, minlength=width)
    reach = np.bincount(rows, minlength=n)
    speed = 1 / (0.25 * top * np.bincount(columns, np.sqrt(reach[rows]), minlength=width) + ridge * n / 100 + 1e-9) * (degree > 0)
    move, move_t = np.zeros(width), np.zeros(top)
    for _ in range(rounds):
        score = np.bincount(rows, w[columns], minlength=n)
        error = logistic(score[:, None] - thresholds) - over
        gradient = np.bincount(columns, error.sum(axis=1)[rows], minlength=width) + ridge * w
        move = 0.9 * move - speed * gradient
        move_t = 0.9 * move_t + error.sum(axis=0) / (0.25 * n * 4)
        w, thresholds = w + move, np.sort(thresholds + move_t)
    return w, thresholds


def told_apart(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, width: int) -> np.ndarray:
    """The features that stand in `SEEN` texts or more, and in toxic ones by `APART` standard deviations more or less than
    chance: a text has hundreds of others, whose noise would drown these."""
    seen, among, share = np.bincount(columns, minlength=width), np.bincount(columns, toxic[rows], minlength=width), toxic.mean()
    return (seen >= SEEN) & (np.abs(among - seen * share) >= APART * np.sqrt(seen * share * (1 - share)))


def fit_documents(documents: list[list[str]], toxic: np.ndarray) -> Model:
    """A model from the distinct words of texts and their labels."""
    index: dict[str, int] = {}
    rows, columns = [], []
    for r, words in enumerate(documents):
        own = {f for w in words for f in features_of(w)}
        rows.append(np.full(len(own), r))
        columns.append(np.array([index.setdefault(f, len(index)) for f in sorted(own)], np.int64))
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    used = told_apart(rows, columns, toxic, len(index))[columns]
    rows, columns = rows[used], columns[used]
    first, _ = fit_ordinal(rows, columns, toxic, len(index))
    marked = np.bincount(rows, (first[columns] > 0.5), minlength=len(toxic)) / np.array([max(1, len(d)) for d in documents])
    severe = marked > np.median(marked[toxic == 1])
    grades = toxic * (1 + severe)
    w, thresholds = fit_ordinal(rows, columns, grades, len(index))
    return Model({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-3}, tuple(thresholds.tolist()))


def best_cut(probability: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F of precision and recall, both counting alike; the middle of the gap below the lowest
    probability it takes, within 0.1 and 0.5, as few rows can say."""
    order = np.argsort(-probability, kind="stable")
    hits = np.cumsum(toxic[order])
    f = 2 * hits / (np.arange(1, len(order) + 1) + max(1, toxic.sum()))
    p = probability[order]
    f[:-1][p[:-1] == p[1:]] = 0  # equal ones fall on the same side
    at = int(f.argmax())
    below = p[at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[at] + below) / 2, 0.1, 0.5))


def _words(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [words_of(t) for t in utf8(batch, "_text")]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["_lid", "_label", "words"])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of the labelled rows of `docs`."""
    known = labels.select(F.col(id_column).alias("_lid"), F.col(label).cast("int").alias("_label"))
    known = known.where("_lid IS NOT NULL AND _label IN (0, 1)").distinct()
    known = known.withColumn("_order", F.xxhash64("_lid", F.lit(6)))
    sides = [(1, sample // 4), (0, sample - sample // 4)]
    first, second = (known.where(F.col("_label") == side).orderBy("_order", "_lid").limit(most) for side, most in sides)
    chosen = first.unionByName(second).drop("_order")
    texts = docs.select(F.col(f"`{id_column}`").alias("_lid"), text_of(text_column).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_lid").select("_lid", "_label", "_text")  # at most `sample` ids
    kind = rows.schema["_lid"].dataType.simpleString()
    learned = map_batches(rows, _words, f"_lid {kind}, _label int, words array<string>").collect()
    learned.sort(key=lambda r: (r["_lid"], r["_label"], r["words"]))
    toxic = np.array([r["_label"] for r in learned], np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model({}, (-30.0,) if len(toxic) and toxic[0] else (30.0,))
    documents = [r["words"] for r in learned]
    kept_out = np.arange(len(learned)) % 5 == 0
    if len(set(toxic[kept_out].tolist())) < 2 or len(set(toxic[~kept_out].tolist())) < 2:
        return fit_documents(documents, toxic)
    model = fit_documents([d for d, out in zip(documents, kept_out) if not out], toxic[~kept_out])
    steps = [grade_steps({f for w in d for f in features_of(w) if f in model.weights}, model) for d, out in zip(documents, kept_out) if out]
    return replace(model, cut=best_cut(np.array(steps)[:, 0], toxic[kept_out]))


def grade_steps(features: set[str], model: Model) -> np.ndarray:
    """P(grade > k) for every threshold."""
    return logistic(sum(model.weights[f] for f in sorted(features)) - np.array(model.thresholds))


def _score(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    known: dict[str, tuple[str, ...]] = {}  # the features of a word that have weights
    found = []
    for text in utf8(batch, "_text"):
        if len(known) > CACHED:
            known = {}
        own: set[str] = set()  # a feature counts once per text
        for word in words_of(text):
            weighty = known.get(word)
            if weighty is None:
                weighty = known[word] = tuple(f for f in features_of(word) if f in model.weights)
            own.update(weighty)
        found.append(grade_steps(own, model))
    steps = np.array(found)
    at_least = np.column_stack([np.ones(len(steps)), steps, np.zeros(len(steps))])
    grade = (at_least[:, :-1] - at_least[:, 1:]).argmax(axis=1).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(steps[:, 0]), pa.array(steps.sum(axis=1)), pa.array(grade), pa.array(steps[:, 0] >= model.cut)],
        ["_id", "toxic_probability", "expected_severity", "severity", "toxic"],
    )


def severities(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, toxic_probability, expected_severity, severity, toxic)."""
    model = fit(docs, labels, id_column, text_column)
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text_of(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, toxic_probability double, expected_severity double, severity int, toxic boolean"
    return map_batches(rows, partial(_score, model=model), schema).withColumnRenamed("_id", id_column)
