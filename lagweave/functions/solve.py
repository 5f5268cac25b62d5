"""Small symmetric systems of equations as array expressions: one system a row, no Python worker."""

from pyspark.sql import Column, functions as F

#: A pivot under this share of the largest diagonal element counts as zero.
TINY = 1e-12


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, as an expression in a lambda is computed anew wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _at(cells: Column, row: Column, col: Column, width: int) -> Column:
    return F.element_at(cells, row * width + col + 1)


def eliminate(cells: Column, size: int) -> Column:
    """Gauss-Jordan elimination of a symmetric, positive semidefinite matrix with one right side: struct(cells, used).

    `cells` has the rows one after the other, each with its right side last. In every step the largest diagonal element left is
    the pivot (the D of an LDL' factorisation); `used` marks the rows that gave one. The others depend on them.
    """
    width = size + 1
    rows = F.sequence(F.lit(0), F.lit(size - 1))
    places = F.sequence(F.lit(0), F.lit(size * width - 1))
    largest = F.array_max(F.transform(rows, lambda i: _at(cells, i, i, width)))

    def step(state, _):
        left = F.transform(rows, lambda i: F.struct(
            F.when(F.element_at(state["used"], i + 1), F.lit(-1.0)).otherwise(_at(state["cells"], i, i, width)).alias("size"), (-i).alias("at")))

        def reduced(pivot):
            p = -pivot["at"]
            lead = lambda c: _at(state["cells"], p, c, width) / pivot["size"]
            cell = lambda r, c: F.when(r == p, lead(c)).otherwise(_at(state["cells"], r, c, width) - _at(state["cells"], r, p, width) * lead(c))
            after = F.struct(
                F.transform(places, lambda k: cell(F.floor(k / width).cast("int"), k % width)).alias("cells"),
                F.transform(rows, lambda i: F.element_at(state["used"], i + 1) | (i == p)).alias("used"),
            )
            return F.when(pivot["size"] > state["tiny"], F.struct(after["cells"], after["used"], state["tiny"].alias("tiny"))).otherwise(state)

        return _let(F.array_max(left), reduced)

    start = F.struct(cells.alias("cells"), F.array_repeat(F.lit(False), size).alias("used"), (largest * F.lit(TINY)).alias("tiny"))
    return F.aggregate(rows, start, step)


def least_norm_solution(cells: Column, size: int) -> Column:
    """The solution with the smallest norm of such a system, as an array; of a consistent system, as normal equations are."""
    width = size + 1
    rows = F.sequence(F.lit(0), F.lit(size - 1))
    places = F.sequence(F.lit(0), F.lit(size * width - 1))

    def solution(done):
        used = lambda i: F.element_at(done["used"], i + 1)
        cell = lambda r, c: _at(done["cells"], r, c, width)
        whole = F.transform(rows, lambda i: cell(i, F.lit(size)))

        # Each row without a pivot is a free variable, and the columns of the free ones give the null space: z of them minimises the norm.
        def gram(r, c):
            inner = F.aggregate(rows, F.lit(0.0), lambda s, p: s + F.when(used(p), cell(p, r) * cell(p, c)).otherwise(0.0))
            same = F.when(r == c, 1.0).otherwise(0.0)
            return F.when(used(r), same).when(c == size, inner).when(used(c), F.lit(0.0)).otherwise(inner + same)

        system = F.transform(places, lambda k: gram(F.floor(k / width).cast("int"), k % width))

        def with_free(z):
            free = lambda i: _at(z["cells"], i, F.lit(size), width)
            moved = lambda i: F.aggregate(rows, cell(i, F.lit(size)), lambda s, f: s - F.when(used(f), 0.0).otherwise(cell(i, f) * free(f)))
            return F.transform(rows, lambda i: F.when(used(i), moved(i)).otherwise(free(i)))

        return F.when(F.forall(done["used"], lambda u: u), whole).otherwise(_let(eliminate(system, size), with_free))

    return _let(eliminate(cells, size), solution)
