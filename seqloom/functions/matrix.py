"""Functions on motif matrices: array<array<double>>, one row of (A, C, G, T) per position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column with no frequency above this is ambiguous.
AMBIGUOUS = 0.4


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def pseudocount(counts: Column, argument: float = 0.01) -> Column:
    """A hundredth of the argument times a quarter of the root of the mean column sum, cut to a whole number."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, col: a + _sum(col))
    return F.floor(F.lit(argument / 0.01) * F.sqrt(total / F.size(counts)) * 0.25).cast("double")


def normalize_columns(counts: Column, added: Column | float = 0.0) -> Column:
    """Probabilities per position after adding a count to every cell."""
    added = F.lit(added) if isinstance(added, float) else added
    return F.transform(counts, lambda col: F.transform(col, lambda x: F.try_divide(x + added, _sum(col) + 4 * added)))


def log_odds(pwm: Column) -> Column:
    """log2(p / 0.25); p = 0 gives minus infinity."""
    return F.transform(pwm, lambda col: F.transform(col, lambda p: F.when(p <= 0, F.lit(float("-inf"))).otherwise(F.log2(p / 0.25))))


def reverse_complement(matrix: Column) -> Column:
    return F.reverse(F.transform(matrix, lambda col: F.reverse(col)))


def trim_ambiguous(matrix: Column, both: bool = False) -> Column:
    """Without its ambiguous first columns (and last ones, if `both`); all ambiguous gives an empty matrix."""
    clear = F.transform(matrix, lambda col: F.array_max(col) > AMBIGUOUS)
    first = F.array_position(clear, True)
    last = F.size(matrix) - F.array_position(F.reverse(clear), True) + 1 if both else F.size(matrix)
    return F.when(first == 0, F.slice(matrix, 1, 0)).otherwise(F.slice(matrix, first.cast("int"), (last - first + 1).cast("int")))


def _deviations(x: Column) -> Column:
    return F.transform(x, lambda v: v - _sum(x) / F.size(x))


def _dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def column_pearson(x: Column, y: Column) -> Column:
    """Pearson correlation of two columns; null where one is constant."""
    a, b = _deviations(x), _deviations(y)
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b)))


def aligned_correlation(m: Column, n: Column) -> Column:
    """Correlation of two matrices of one width, each cell less its own column's mean."""
    flat = lambda x: F.flatten(F.transform(x, _deviations))
    a, b = flat(m), flat(n)
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b)))


def matrix_distance(m: Column, n: Column) -> Column:
    """A quarter of the root of the summed squared differences."""
    a, b = F.flatten(m), F.flatten(n)
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))) / 4


def column_match_score(x: Column, y: Column) -> Column:
    """+1 for each pair of equal bases and -1 for each other pair, weighted by their frequencies."""
    return 2 * _dot(x, y) - _sum(x) * _sum(y)


def consensus(matrix: Column) -> Column:
    """Most frequent base of each position, the first on ties."""
    return F.array_join(F.transform(matrix, lambda col: F.substring(F.lit("ACGT"), F.array_position(col, F.array_max(col)).cast("int"), F.lit(1))), "")
