"""Expressions over an edge's time series (array<double>) and over sets of edge ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_series(text: Column) -> Column:
    """Comma-separated numbers as array<double>."""
    return F.transform(F.split(text, ","), lambda x: x.cast("double"))


def exists_at(series: Column, t: Column) -> Column:
    """Whether the edge is alive in snapshot t (0-based)."""
    return F.coalesce(F.get(series, t) > 0, F.lit(False))


def alive(series: Column) -> Column:
    """The snapshots in which the edge is alive."""
    return F.filter(F.transform(series, lambda x, t: F.when(x > 0, t)), lambda t: t.isNotNull())


def total(series: Column) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda a, x: a + x)


def support(series: Column, weighted: bool = False) -> Column:
    """Snapshots alive, or in weighted graphs the sum of the series."""
    return total(series) if weighted else F.size(F.filter(series, lambda x: x > 0)).cast("double")


def mean(series: Column) -> Column:
    return total(series) / F.nullif(F.size(series), F.lit(0))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def centred(series: Column) -> Column:
    return let(mean(series), lambda m: F.transform(series, lambda x: x - m))


def norm(series: Column) -> Column:
    return F.sqrt(F.aggregate(series, F.lit(0.0), lambda a, x: a + x * x))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def zscore(series: Column) -> Column:
    """Standard scores by the population deviation; null where the series is constant."""

    def scaled(dev: Column) -> Column:
        return let(norm(dev) / F.sqrt(F.size(dev)), lambda sd: F.when(sd > 0, F.transform(dev, lambda x: x / sd)))

    return let(centred(series), scaled)


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r of two series; null for constant ones and for lengths that differ or are under two."""

    def r(dx: Column, dy: Column) -> Column:
        return let(norm(dx) * norm(dy), lambda n: F.when(n > 0, dot(dx, dy) / n))

    alike = (F.size(x) == F.size(y)) & (F.size(x) >= 2)
    return F.when(alike, let(centred(x), lambda dx: let(centred(y), lambda dy: r(dx, dy))))


def euclidean(x: Column, y: Column) -> Column:
    """Similarity 1 / (1 + Euclidean distance)."""
    return 1 / (1 + norm(F.zip_with(x, y, lambda a, b: a - b)))


#: The correlation measures by name: the extension point for others.
MEASURES = {"pearson": pearson, "euclidean": euclidean}


def jaccard(x: Column, y: Column) -> Column:
    """Jaccard similarity of two sets given as arrays; 0 for two empty ones."""
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def contained(x: Column, y: Column) -> Column:
    """Whether set x is part of set y."""
    return F.size(F.array_except(x, y)) == 0


def nodes_of(ends: Column) -> Column:
    """The distinct nodes of an array of (src, dst) structs."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.array(e["src"], e["dst"])))))


def set_text(edges: Column) -> Column:
    """A set of ids as ascending text, joined by commas."""
    return F.array_join(F.array_sort(edges), ",")
