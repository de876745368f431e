"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: str, b: str) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: str) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalised(a: str) -> Column:
    n = norm(a) + F.lit(1e-12)
    return F.transform(a, lambda x: x.cast("double") / n)


def sign_bits(a: str) -> Column:
    """Bit i is set if component i is positive; up to 64 components."""
    return F.aggregate(F.zip_with(a, F.sequence(F.lit(0), F.size(a) - 1), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda t, x: t.bitwiseOR(x))
