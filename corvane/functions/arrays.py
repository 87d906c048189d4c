"""Array and matrix expressions: position alignment, pooling, concatenation, row and column deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS, ALIGNED = 13, 9


def alignment_weights(length: int) -> list[list[float]]:
    """The 9 x 13 matrix that maps the positions of a peptide of 8 to 13 residues to nine.

    The first three and the last position stay. The centre, from the fourth on to the last but one, becomes five:
    a longer one as the means of five runs, whose first ones are one longer if it can't be cut evenly; a shorter one
    by taking the nearest of evenly spread places, halves to even.
    """
    centre = list(range(3, length - 1))
    n = len(centre)
    if n >= 5:
        small, more = divmod(n, 5)
        runs, at = [], 0
        for i in range(5):
            size = small + (i < more)
            runs.append(centre[at : at + size])
            at += size
    else:
        runs = [[centre[round(i * (n - 1) / 4)]] for i in range(5)]
    rows = [[0], [1], [2], *runs, [length - 1]]
    return [[1 / len(r) if c in r else 0.0 for c in range(POSITIONS)] for r in rows]


def align(values: Column, length: Column) -> Column:
    """Nine values out of thirteen by the peptide's length; null for lengths other than 8 to 13. Null counts as 0.

    The places that each cell is the mean of are one constant map by length.
    """
    places = F.expr("map(" + ", ".join(f"{n}, array({', '.join(_places(n))})" for n in range(8, POSITIONS + 1)) + ")")
    cell = lambda at: F.aggregate(at, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(values, i).cast("double"), F.lit(0.0))) / F.size(at)
    return F.transform(F.try_element_at(places, length.cast("int")), cell)


def aligned_cells(cells: list[str], length: str) -> list[Column]:
    """Nine columns out of thirteen, given as SQL texts, as ``align`` has them: plain sums by length, which Spark compiles."""
    filled = [f"coalesce(cast({c} AS double), 0D)" for c in cells]
    mean = lambda row: "(" + " + ".join(filled[i] for i, w in enumerate(row) if w) + f") / {sum(w > 0 for w in row)}"
    weights = {n: alignment_weights(n) for n in range(8, POSITIONS + 1)}
    return [F.expr(f"CASE {length} " + " ".join(f"WHEN {n} THEN {mean(rows[k])}" for n, rows in weights.items()) + " END") for k in range(ALIGNED)]


def _places(length: int) -> list[str]:
    return [f"array({', '.join(str(i) for i, w in enumerate(row) if w)})" for row in alignment_weights(length)]


def mean_vector(vectors: Column) -> Column:
    """The element-wise mean of an array of equally long vectors; null for none."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def unit(vector: Column) -> Column:
    """The vector over its Euclidean norm; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def pool(vectors: Column, first: Column, last: Column, normalise: bool = False) -> Column:
    """The mean of the vectors from place ``first`` to ``last`` (from 1, inclusive), each scaled to norm 1 if asked for."""
    part = F.slice(vectors, first, last - first + 1)
    return mean_vector(F.transform(part, unit) if normalise else part)


def has_nan(vector: Column) -> Column:
    return F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def without_places(values: Column, gone: Column) -> Column:
    """An array without the elements at the listed indices (from 0), which are looked up by hash."""
    places = F.array_except(F.sequence(F.lit(0), F.size(values) - 1), gone.cast("array<int>"))
    return F.when(F.size(values) > 0, F.transform(places, lambda i: F.get(values, i))).otherwise(values)


def without(matrix: Column, gone: Column) -> Column:
    """A matrix without the rows and columns of the listed indices (from 0)."""
    return F.transform(without_places(matrix, gone), lambda row: without_places(row, gone))


def sum_skip_null(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])


def mean_skip_null(a: Column, b: Column) -> Column:
    """The mean of those of two values that aren't null."""
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / F.nullif(n, F.lit(0))
