"""A random order as a permutation of the positions 1 .. n of a key, computed row by row.

A row's place follows from (key, position, size, seed) alone: no digest is sorted and nothing is exchanged, so the cost does not depend on how the
rows are spread over the keys. The permutation is a Feistel network on pairs (left, right) of a grid of a x b >= n cells, where a is
the root of n: each round adds a hash of one part to the other one, which can be undone, so no two positions share a place. The grid has fewer
than a cells beyond n. A position that lands on one goes through the network again until it is back among the first n, at most as many times as
there are such cells; that is a permutation of 1 .. n for every n.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

PRIME = (1 << 31) - 1
ROUNDS = 6
DIGITS = 7  # of the digest of the key for each of the hash's numbers


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _div(x: Column, y: Column) -> Column:
    """Whole quotient of numbers that are not negative."""
    return F.call_function("div", x, y)


def _numbers(keys: Sequence[str], seed: int) -> Column:
    """Eight numbers below 2^28 for each key."""
    digest = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"), 256)
    return _let(digest, lambda d: F.array(*[F.conv(F.substr(d, F.lit(1 + DIGITS * k), F.lit(DIGITS)), 16, 10).cast("bigint") for k in range(8)]))


def _hash(x: Column, numbers: Column, step: int) -> Column:
    # Each factor is below 2^31, so products fit a long.
    line = ((x % PRIME) * (numbers[step] + 1) + numbers[(step + 2) % 8]) % PRIME
    return _let(line, lambda h: (h * h % PRIME) * h % PRIME)


def _network(cell: Column, numbers: Column, a: Column, b: Column) -> Column:
    """The cell that `cell` goes to: left * b + right."""

    def rounds(left: Column, right: Column, step: int) -> Column:
        if step == ROUNDS:
            return left * b + right
        if step % 2 == 0:
            return _let((left + _hash(right, numbers, step)) % a, lambda x: rounds(x, right, step + 1))
        return _let((right + _hash(left, numbers, step)) % b, lambda x: rounds(left, x, step + 1))

    return rounds(_div(cell, b), cell % b, 0)


def place(position: Column, size: Column, numbers: Column) -> Column:
    """The place of `position` among 1 .. `size`; NULL if one of them is, or if the position is not among them."""

    def walk(n, a, b, keys):
        first = _network(position.cast("bigint") - 1, keys, a, b)
        again = lambda at: F.aggregate(F.sequence(F.lit(1), a), at, lambda cell, _: F.when(cell < n, cell).otherwise(_network(cell, keys, a, b)))
        return _let(first, lambda at: F.when(at < n, at).otherwise(again(at))) + 1

    def grid(n):
        return _let(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), lambda a: _let(_div(n + a - 1, a), lambda b: _let(numbers, lambda keys: walk(n, a, b, keys))))

    return F.when((position >= 1) & (position <= size), _let(size.cast("bigint"), grid))


def permuted(rows: DataFrame, keys: Sequence[str] = ("site_id",), position: str = "idx", size: str = "n_train", seed: int = 42) -> DataFrame:
    """Adds `shuffle_pos`, a reproducible random order of the rows of each key.

    `position` numbers the rows of a key from 1 to `size`, as the train windows of `lag_windows` do. Equal for any partitioning of the rows. A row whose position
    is not among 1 .. `size` has no place (NULL). Sizes up to 2^52.
    """
    return rows.withColumn("shuffle_pos", place(F.col(position), F.col(size), _numbers(keys, seed)))


def permuted_tail(rows: DataFrame, share: float = 0.1, size: str = "n_train", **how) -> DataFrame:
    """Marks the last `share` of the permuted rows of each key with `is_validation`."""
    cut = F.floor(F.col(size).cast("double") * F.lit(1.0 - share))
    return permuted(rows, size=size, **how).withColumn("is_validation", F.col("shuffle_pos") > cut)
