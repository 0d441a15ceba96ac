"""Numbers from numbers: stable sigmoids, chi-square, vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1 + F.exp(-F.abs(x))))


def hash_unit(text: Column) -> Column:
    """The first 32 bits of the text's SHA-256 as a number from 0 to 1."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def chi2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of a two-by-two table; 0 if a row or column of it is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below == 0, 0.0).otherwise((a + b + c + d) * (a * d - b * c) * (a * d - b * c) / F.when(below == 0, 1.0).otherwise(below))


def half_credit(left: Column, right: Column) -> Column:
    """1 where left is larger, 0.5 for a tie."""
    return F.when(left > right, 1.0).when(left == right, 0.5).otherwise(0.0)


# --- vectors -------------------------------------------------------------------------------------------------------------


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, eps: float = 1e-12) -> Column:
    return F.get(F.transform(F.array(F.greatest(norm(v), F.lit(eps))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))
