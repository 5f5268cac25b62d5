"""Boosted regression trees over all keys, grown the way MLlib's `GBTRegressor` grows them, without rows in a cache.

MLlib keeps every row as an object of some hundred bytes, and its labels and errors beside it, and puts on disk what memory does not take. Here
the lags of a row are written once, as bins of five bits in whole numbers, next to its target: 16 bytes for twelve lags. A depth of a tree is one pass
over that table. A task counts and sums its rows by (node, lag, bin) in arrays of fixed size and gives one row per cell, so neither disk nor memory
grows with the number of trees. Predictions of the trees before are computed anew from the bins.

Split candidates, gains, ties (the lower lag, then the lower bin), leaves, learning rate and early stop are MLlib's, and so is the model.
"""

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import discard, fresh_path

BINS, BITS, PER_LONG = 32, 5, 12
#: MLlib looks for split candidates in about so many rows.
SAMPLE = 10_000
RATE, TOLERANCE, EPSILON = 0.1, 0.01, 2.0**-52
EQUAL = 1e-11


def fit_trees(train: DataFrame, features: Sequence[str], label: str, held: str | None, rounds: int, depth: int, seed: int) -> GBTRegressionModel:
    """A model of `rounds` trees at most; rows with `held` only say when to stop. `train` is read three times."""
    spark = train.sparkSession
    rows = train.select(*features, F.col(label).cast("double").alias("_y"), (F.col(held) if held else F.lit(False)).alias("_held"))
    fit = rows.where(~F.col("_held"))
    n = fit.count()
    if not n:
        raise ValueError("no rows to fit")
    thresholds = _candidates(fit.select(*features), n, seed)
    path = fresh_path(spark, "binned")
    longs = [f"_b{k}" for k in range(-(-len(features) // PER_LONG))]
    schema = ", ".join([*[f"{c} long" for c in longs], "_y double", "_held boolean"])
    rows.mapInArrow(_binned(thresholds, longs), schema).write.parquet(path)
    grown = _grow(spark.read.schema(schema).parquet(path), longs, thresholds, held is not None, rounds, depth)
    discard(spark, path)
    return _model(spark, grown, thresholds)


def _candidates(fit: DataFrame, n: int, seed: int) -> list[np.ndarray]:
    """Thresholds per feature: all midpoints of the values seen if these are few, else those that cut them most evenly."""
    bins = min(BINS, n)
    share = min(1.0, max(bins * bins, SAMPLE) / n)
    found = (fit if share == 1 else fit.sample(False, share, seed)).toArrow()  # some ten thousand rows, for any table
    out = []
    for column in found.columns:
        values = column.to_numpy()
        values, counts = np.unique(values[values != 0], return_counts=True)
        counts = counts.astype(float)
        zeros = share * n - counts.sum()  # MLlib infers them
        if zeros > EPSILON * n * n:
            at = np.searchsorted(values, 0.0)
            values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
        between = (values[:-1] + values[1:]) / 2
        if len(between) > bins - 1:
            stride = share * n / bins
            so_far, target, kept = counts[0], stride, []
            for k in range(1, len(values)):
                before, so_far = so_far, so_far + counts[k]
                if abs(before - target) < abs(so_far - target):
                    kept.append(k - 1)
                    target += stride
            between = between[kept]
        out.append(between)
    return out


def _binned(thresholds, longs):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.zeros(batch.num_rows, np.int64) for _ in longs]
            for f, cuts in enumerate(thresholds):
                values = batch.column(f).to_numpy(zero_copy_only=False)
                if np.isnan(values).any():
                    raise ValueError("lags must not be missing")
                codes[f // PER_LONG] |= np.searchsorted(cuts, values, side="left") << (BITS * (f % PER_LONG))
            yield pa.RecordBatch.from_arrays([*map(pa.array, codes), batch.column(len(thresholds)), batch.column(len(thresholds) + 1)], [*longs, "_y", "_held"])

    return run


class _Tree:
    """Inner nodes in heap order to the full depth, then the leaves; a leaf higher up sends its rows left to the lowest depth."""

    def __init__(self, depth: int):
        self.depth, inner = depth, 2**depth - 1
        self.feature, self.cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        self.value = np.zeros(inner + 1)
        self.stats: dict[int, tuple] = {}  # by node: count, sum and sum of squares
        self.gains: dict[int, float] = {}  # of the nodes that are split

    def node(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row at a depth, counted from the root."""
        at, each = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(depth):
            at = 2 * at + 1 + (bins[self.feature[at], each] > self.cut[at])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node(bins, self.depth) - len(self.cut)]

    def close(self, node: int) -> None:
        """Makes a node a leaf."""
        n, total, _ = self.stats[node]
        while node < len(self.cut):
            node = 2 * node + 1
        self.value[node - len(self.cut)] = total / n


def _cells(trees, tree, level, nodes, features, longs, with_held):
    """Sums per (node of `nodes`, feature, bin) of the rows' residuals, in slots; the squared error of held rows in slot -1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(nodes) * features * BINS
        place = np.full(2 ** (level + 1), -1, np.int64)
        place[list(nodes)] = np.arange(len(nodes))
        sums, error = np.zeros((3, size)), np.zeros(2)
        lag = np.arange(features)[:, None] * BINS
        for batch in batches:
            codes = [batch.column(k).to_numpy() for k in range(len(longs))]
            y, held = (batch.column(len(longs) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            bins = np.stack([(codes[f // PER_LONG] >> (BITS * (f % PER_LONG))) & (BINS - 1) for f in range(features)])
            rest = y
            if trees:
                ahead = trees[0].predict(bins)
                for t in trees[1:]:
                    ahead = ahead + RATE * t.predict(bins)
                off = y - ahead
                if with_held:
                    error += held.sum(), (off[held] ** 2).sum()
                rest = 2 * off  # minus the gradient of the squared error
            if nodes:
                at = place[tree.node(bins, level)]
                own = (at >= 0) & ~held
                slots = (at[own] * (features * BINS) + lag + bins[:, own]).ravel()
                rest = rest[own]
                for k, weights in enumerate((None, rest, rest * rest)):
                    sums[k] += np.bincount(slots, None if weights is None else np.tile(weights, features), size)
        used = np.flatnonzero(sums[0])
        parts = [np.append(used, -1), *[np.append(s[used], e) for s, e in zip(sums, (*error, 0.0))]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, parts)], ["slot", "n", "s", "q"])

    return run


def _grow(table: DataFrame, longs, thresholds, with_held, rounds, depth) -> list[_Tree]:
    features = len(thresholds)

    def summed(trees, tree, level, nodes):
        rows = table.where("_held") if not nodes else table if with_held else table.where("NOT _held")
        cells = rows.mapInArrow(_cells(trees, tree, level, nodes, features, longs, with_held and not level), "slot long, n double, s double, q double")
        found = cells.groupBy("slot").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()  # a row per node, lag and bin
        sums, error = np.zeros((3, len(nodes) * features * BINS)), (0.0, 0.0)
        for slot, *own in found:
            if slot < 0:
                error = own[:2]
            else:
                sums[:, slot] = own
        return sums.reshape(3, len(nodes), features, BINS), error[1] / error[0] if error[0] else float("nan")

    trees, best, n_best = [], None, 0

    def stops(error):
        """Whether the last tree was no gain for the held rows."""
        nonlocal best, n_best
        if best is not None and best - error < TOLERANCE * max(error, 0.01):
            return True
        if best is None or error < best:
            best, n_best = error, len(trees)
        return False

    for _ in range(rounds):
        tree, nodes = _Tree(depth), [0]
        for level in range(depth):
            sums, error = summed(trees, tree, level, nodes)
            if not level and trees and with_held and stops(error):  # the first depth has seen the trees so far
                return trees[:n_best]
            nodes = _split(tree, level, nodes, sums, thresholds)
            if not nodes:
                break
        trees.append(tree)
    if with_held:
        stops(summed(trees, None, 0, [])[1])
    return trees[:n_best] if with_held else trees


def _impurity(n, s, q):
    return (q - s * s / n) / n


def _split(tree: _Tree, level: int, nodes: list[int], sums: np.ndarray, thresholds) -> list[int]:
    """Splits the nodes of a depth where that gains something; the children that may be split in turn."""
    after = []
    for k, node in enumerate(nodes):
        own = sums[:, k]
        if not level:
            tree.stats[0] = tuple(own[:, 0].sum(1))
        total = np.array(tree.stats[node])
        left = own.cumsum(2)
        right = left[:, :, -1:] - left
        offered = np.arange(BINS) < np.array([len(c) for c in thresholds])[:, None]
        with np.errstate(all="ignore"):
            n = total[0]
            gain = _impurity(*total) - left[0] / n * _impurity(*left) - right[0] / n * _impurity(*right)
        gain = np.where(offered & (left[0] >= 1) & (right[0] >= 1), gain, -np.inf)
        # Gains that differ by the order of their sums are equal.
        f, cut = np.unravel_index(int(np.argmax(gain >= gain.max() * (1 - EQUAL))), gain.shape)
        if not gain.max() > 0:
            tree.close(node)
            continue
        tree.feature[node], tree.cut[node], tree.gains[node] = f, cut, float(gain[f, cut])
        for child, side in ((2 * node + 1, left), (2 * node + 2, right)):
            tree.stats[child] = tuple(side[:, f, cut])
            if level + 1 == tree.depth or abs(_impurity(*tree.stats[child])) < EPSILON:
                tree.close(child)
            else:
                after.append(child)
    return after


def _model(spark: SparkSession, trees: list[_Tree], thresholds) -> GBTRegressionModel:
    """MLlib's model of the trees."""
    jvm, gateway, features = spark._jvm, spark.sparkContext._gateway, len(thresholds)
    ml, regression = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression

    def doubles(values):
        out = gateway.new_array(jvm.double, len(values))
        for k, v in enumerate(values):
            out[k] = float(v)
        return out

    def node(tree, at):
        """(node, its prediction if it is a leaf)"""
        n, s, q = (float(x) for x in tree.stats[at])
        stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(doubles((n, s, q)), int(n))
        own = (s / n, float(_impurity(n, s, q)))
        if at in tree.gains:
            (left, a), (right, b) = node(tree, 2 * at + 1), node(tree, 2 * at + 2)
            if a is None or a != b:  # two leaves of one prediction are one
                f = int(tree.feature[at])
                split = ml.ContinuousSplit(f, float(thresholds[f][tree.cut[at]]))
                return ml.InternalNode(*own, tree.gains[at], left, right, split, stats), None
        return ml.LeafNode(*own, stats), own[0]

    grown = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    for k, tree in enumerate(trees):
        uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("dtr")
        grown[k] = regression.DecisionTreeRegressionModel(uid, node(tree, 0)[0], features)
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("GBTRegressor")
    return GBTRegressionModel(regression.GBTRegressionModel(uid, grown, doubles([1.0] + [RATE] * (len(trees) - 1)), features))
