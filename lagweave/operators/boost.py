"""Boosted trees by histograms, for every key at once, as rows of coefficients.

Lags are cut into `BINS` even bins of their scaled range. One aggregate of (key, node, lag, bin) counts and residual sums a depth finds the splits
of all keys: map-side partials have at most as many rows as there are keys, nodes, lags and bins. The last depth's sums give the leaves as well. A key's
ensemble is one array, `[base, tree, tree, ..]`; a tree is its inner nodes as pairs of lag and threshold in heap order, then its leaves:
models of this type stand in the same table as the linear ones and are evaluated in generated code by the same scan.

Residuals are integers, in units of 2**-20, and so are leaves: sums do not depend on their order, and a lost task or
another partitioning gives the same trees. Ties go to the lower lag, then the lower bin. A node that no bin border divides sends
all rows to the left. Lags outside [0, 1] fall in the outermost bins.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.metrics import mape_eps
from ..sources.shared import stored
from .lookup import lookup
from .windows import LENGTH, validation_tail

UNIT = float(1 << 20)
BINS = 16
DEPTH = 2
ROUNDS = 5
RATE = 0.5
MODEL = "boost"


def tree_size(depth: int = DEPTH) -> int:
    """Numbers of a tree: lag and threshold of each inner node, value of each leaf."""
    return 2 * (2**depth - 1) + 2**depth


def tree_leaf(coef: Column, lags: Column, tree: int, depth: int) -> Column:
    """The place of the leaf that a row falls in, counted from the root in heap order."""
    begin = 2 + tree * tree_size(depth)

    def below(node: int) -> Column:
        if node >= 2**depth - 1:
            return F.lit(node)
        lag, threshold = F.element_at(coef, begin + 2 * node), F.element_at(coef, begin + 2 * node + 1)
        return F.when(F.element_at(lags, lag.cast("int")) < threshold, below(2 * node + 1)).otherwise(below(2 * node + 2))

    return below(0)


def tree_value(coef: Column, lags: Column, tree: int, depth: int) -> Column:
    """What a tree adds to a row; zero if the ensemble has fewer trees."""
    begin, inner = 2 + tree * tree_size(depth), 2**depth - 1
    value = F.element_at(coef, F.lit(begin + 2 * inner) + tree_leaf(coef, lags, tree, depth) - F.lit(inner))
    return F.when(F.size(coef) >= begin + tree_size(depth) - 1, value).otherwise(0.0)


def boost_prediction(coef: Column, length: int = LENGTH, trees: int = ROUNDS, depth: int = DEPTH) -> Column:
    lags = F.array(*[F.col(f"lag_{k}") for k in range(1, length + 1)])
    out = F.element_at(coef, 1)
    for tree in range(trees):
        out = out + tree_value(coef, lags, tree, depth)
    return out


def lag_bin(lag: Column, bins: int = BINS) -> Column:
    return F.least(F.greatest(F.floor(lag * F.lit(float(bins))), F.lit(0)), F.lit(bins - 1)).cast("int")


def _coded(names: Sequence[str], bins: int) -> list[Column]:
    """The bins of the lags, packed into as few whole numbers as hold them; `bins` stands for a lag that is no number."""
    bits, out = bins.bit_length(), []
    code = lambda c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(bins)).otherwise(lag_bin(F.col(c), bins)).cast("bigint")
    for begin in range(0, len(names), 63 // bits):
        word = F.lit(0).cast("bigint")
        for k, c in enumerate(names[begin : begin + 63 // bits]):
            word = word.bitwiseOR(F.shiftleft(code(c), bits * k))
        out.append(word.alias(f"_w{begin // (63 // bits)}"))
    return out


def _code(k: int, bins: int) -> Column:
    """The bin of the k-th lag (from 0) out of the packed ones."""
    bits = bins.bit_length()
    word, place = divmod(k, 63 // bits)
    return F.shiftright(F.col(f"_w{word}"), bits * place).bitwiseAND(F.lit((1 << bits) - 1))


def _decoded(names: Sequence[str], bins: int) -> list[Column]:
    """The middle of every lag's bin: on the same side of all bin borders as the lag itself."""
    middle = lambda c: F.when(c == bins, F.lit(float("nan"))).otherwise((c + F.lit(0.5)) / F.lit(float(bins)))
    return [middle(_code(k, bins)).alias(c) for k, c in enumerate(names)]


def fit_boost(
    train: DataFrame, keys: Sequence[str] = ("site_id",), length: int = LENGTH, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE
) -> DataFrame:
    """(keys, model_type, coef) of boosted trees on the rows of `train`; `keys=()` fits one ensemble over all of them.

    Two passes a round at depth 2 over a stored table of bins and targets; models, with the splits found so far, are one small stored table
    a pass, whose size Spark knows. Thresholds are bin borders, so the bin of a lag says all that a tree asks of it: the rows are a number or two beside the
    target. They lie by key, so a task sums few keys; hot keys are dealt to several tasks.
    """
    by = list(keys) or ["_all"]
    names = [f"lag_{k}" for k in range(1, length + 1)]
    target = F.floor(F.col("y") * F.lit(UNIT) + 0.5).cast("bigint")
    rows = train if keys else train.withColumn("_all", F.lit("all"))
    rows = rows.select(*by, *_coded(names, bins), target.alias("_y"))
    rows = stored(rows.hint("rebalance", *by) if keys else rows, "boost-rows")
    base = F.floor(F.sum("_y").cast("double") / F.count(F.lit(1))) / F.lit(UNIT)
    models = stored(rows.groupBy(*by).agg(F.array(base).alias("coef")), "boost")
    lags = F.array(*names)
    codes = [F.when(_code(k, bins) == bins, 0).otherwise(_code(k, bins)).cast("int").alias(f"_b{k}") for k in range(length)]
    for tree in range(rounds):
        known = models
        for level in range(depth):
            residual = F.col("_y") - F.round(boost_prediction(F.col("coef"), length, tree, depth) * F.lit(UNIT)).cast("bigint")
            node = _node(F.col("_splits"), lags, level) if level else F.lit(0)
            decoded = lookup(rows, known, by).select("*", *_decoded(names, bins))
            placed = decoded.select(*by, node.alias("_node"), residual.alias("_s"), *codes)
            found = _best_splits(placed, by, [f"_b{k}" for k in range(length)], level, bins)
            known = stored(_with_splits(known, found, by, level), "splits")
        models = stored(_with_tree(known, by, depth, rate), "boost")
    out = models.select(*keys, F.lit(MODEL).alias("model_type"), "coef")
    return out


def _node(splits: Column, lags: Column, level: int) -> Column:
    """The node of this level that a row falls in, given the nodes above as an array of (lag, threshold) in heap order."""

    def below(node: int) -> Column:
        if node >= 2**level - 1:
            return F.lit(node)
        own = F.element_at(splits, node + 1)
        return F.when(F.element_at(lags, own["lag"]) < own["threshold"], below(2 * node + 1)).otherwise(below(2 * node + 2))

    return below(0)


def _best_splits(placed, by, names, level, bins):
    """(keys, _here): the nodes of this level, with counts and sums of both sides."""
    cells = placed.select(*by, "_node", "_s", F.posexplode(F.array(*names)).alias("_lag", "_bin"))
    sums = cells.groupBy(*by, "_node", "_lag", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("_s").alias("_s"))
    lag = Window.partitionBy(*by, "_node", "_lag")
    upto = lag.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select(
        *by, "_node", "_lag", "_bin", F.sum("_n").over(upto).alias("_nl"), F.sum("_s").over(upto).alias("_sl"),
        F.sum("_n").over(lag).alias("_n"), F.sum("_s").over(lag).alias("_s"),
    )
    nr, sr = F.col("_n") - F.col("_nl"), F.col("_s") - F.col("_sl")
    left, right = F.col("_sl").cast("double"), sr.cast("double")
    gain = F.when(nr > 0, left * left / F.col("_nl") + right * right / nr).otherwise(F.lit(-1.0))
    best = F.max(
        F.struct(gain.alias("gain"), (-F.col("_lag")).alias("lag"), (-F.col("_bin")).alias("bin"), "_nl", "_sl", nr.alias("_nr"), sr.alias("_sr"))
    ).alias("_best")
    chosen = cut.groupBy(*by, "_node").agg(best)
    split = F.col("_best.gain") >= 0
    node = F.struct(
        (F.lit(1) - F.col("_best.lag")).alias("lag"),
        # Without a border all rows go to the left, whose sums are those of the last bin.
        F.when(split, (F.lit(1) - F.col("_best.bin")) / F.lit(float(bins))).otherwise(F.lit(float("inf"))).alias("threshold"),
        F.col("_best._nl").alias("nl"), F.col("_best._sl").alias("sl"), F.col("_best._nr").alias("nr"), F.col("_best._sr").alias("sr"),
    )
    entry = F.map_from_entries(F.collect_list(F.struct("_node", node.alias("split"))))
    found = chosen.groupBy(*by).agg(entry.alias("_found"))
    # A node that no row reaches has no sums.
    none = F.struct(
        F.lit(1).alias("lag"), F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("nl"), F.lit(0).cast("bigint").alias("sl"),
        F.lit(0).cast("bigint").alias("nr"), F.lit(0).cast("bigint").alias("sr"),
    )
    here = F.array(*[F.coalesce(F.try_element_at("_found", F.lit(k)), none) for k in range(2**level - 1, 2 ** (level + 1) - 1)])
    return found.select(*by, here.alias("_here"))


def _with_splits(known, found, by, level):
    """(keys, coef, _splits): the models with the nodes from the root to this level."""
    splits = F.concat("_splits", "_here") if level else F.col("_here")
    return lookup(known, found, by).select(*by, "coef", splits.alias("_splits"))


def _with_tree(known, by, depth, rate):
    inner = 2**depth - 1
    nodes = F.transform("_splits", lambda s: F.array(s["lag"].cast("double"), s["threshold"]))
    leaf = lambda s, n: F.when(n > 0, F.floor(s.cast("double") * F.lit(rate) / n) / F.lit(UNIT)).otherwise(0.0)
    last = F.slice("_splits", 2 ** (depth - 1), inner - 2 ** (depth - 1) + 1)
    leaves = F.transform(last, lambda s: F.array(leaf(s["sl"], s["nl"]), leaf(s["sr"], s["nr"])))
    return known.select(*by, F.concat("coef", F.flatten(nodes), F.flatten(leaves)).alias("coef"))


def boost_history(
    train: DataFrame, keys: Sequence[str] = ("site_id",), length: int = LENGTH, rounds: int = ROUNDS, depth: int = DEPTH, share: float = 0.1, **how
) -> DataFrame:
    """(keys, model_type, epoch, loss, mape, val_loss, val_mape): one epoch per round, the columns of a stored history.

    Fitted on the rows before the validation tail of the shuffled train rows. All rounds come from one pass, which adds up the trees.
    """
    marked = stored(validation_tail(train, share, keys=keys), "marked")
    coefs = fit_boost(marked.where(~F.col("is_validation")), keys, length, rounds, depth, **how)
    scored = lookup(marked, coefs, list(keys))
    held, y = F.col("is_validation"), F.col("y")
    measures = []
    for epoch in range(1, rounds + 1):
        p = boost_prediction(F.col("coef"), length, epoch, depth)
        error = (y - p) * (y - p)
        side = lambda when, x: F.when(when, x)
        measures.append(
            F.struct(
                F.lit(epoch).alias("epoch"),
                F.avg(side(~held, error)).alias("loss"), mape_eps(side(~held, y), p).alias("mape"),
                F.avg(side(held, error)).alias("val_loss"), mape_eps(side(held, y), p).alias("val_mape"),
            ).alias(f"_e{epoch}")
        )
    wide = scored.groupBy(*keys).agg(*measures)
    return wide.select(*keys, F.lit(MODEL).alias("model_type"), F.inline(F.array(*[f"_e{k}" for k in range(1, rounds + 1)])))
