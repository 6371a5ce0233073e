"""Vector arithmetic as column expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def usable(v: Column, dim: int) -> Column:
    """Vectors that can be compared: full length, finite, not all zero. Null counts as unusable."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    length = norm(v) + F.lit(EPSILON)
    return F.transform(doubles(v), lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def retrieval_score(cos: Column) -> Column:
    """Store score of a cosine: (1 + cos) / 2, in [0, 1]."""
    return (1 + cos) / 2


def argmax(v: Column) -> Column:
    """Position from 0 of the first largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top_n(v: Column, n: int) -> Column:
    """The n largest values as (k, u), largest first; ties to the smaller position."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("minus"), i.cast("int").alias("k")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: F.struct(p.k.alias("k"), (-p.minus).alias("u")))


def entropy(u: Column) -> Column:
    return -F.aggregate(u, F.lit(0.0), lambda s, x: s + x * F.log(x + F.lit(EPSILON)))


def distances(v: Column, centers: Column) -> Column:
    def far(c: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    return F.transform(centers, far)


def memberships(d: Column, m: float, shared: bool) -> Column:
    """Fuzzy memberships of distances ``d``.

    A vector on a centre belongs to it alone: with ``shared`` (inference) coincident centres share 1,
    without (training) each gets 1.
    """
    power = -2.0 / (m - 1.0)
    on = F.transform(d, lambda x: F.when(x < 1e-10, 1.0).otherwise(0.0))
    hits = F.aggregate(on, F.lit(0.0), lambda s, x: s + x)
    w = F.transform(d, lambda x: F.pow(x, F.lit(power)))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    spread = F.transform(w, lambda x: x / total)
    return F.when(hits > 0, F.transform(on, lambda x: x / hits) if shared else on).otherwise(spread)
