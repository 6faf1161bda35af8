"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def normalised(vector: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    norm = F.sqrt(_sum(F.transform(doubles(vector), lambda x: x * x)))
    return F.when(norm > 0, F.transform(doubles(vector), lambda x: x / norm)).otherwise(doubles(vector))


def mean_pool(vectors: Column) -> Column:
    """Mean of an array of vectors of one width, normalised."""
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, doubles(v), lambda x, y: x + y))
    return normalised(F.transform(total, lambda x: x / F.size(vectors)))


def hashed_embedding(terms: Column, width: int = 128) -> Column:
    """A deterministic embedding without a model: terms hashed (MD5) to signed components, normalised."""
    number = lambda t, at: F.conv(F.substring(F.md5(t.cast("binary")), at, 8), 16, 10).cast("long")
    places = F.transform(terms, lambda t: F.struct((number(t, 1) % width).alias("slot"), F.when(number(t, 9) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))
    at = lambda i: F.aggregate(places, F.lit(0.0), lambda acc, p: acc + F.when(p["slot"] == i, p["sign"]).otherwise(0.0))
    return normalised(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at))
