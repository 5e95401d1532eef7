"""Vector and score arithmetic as Column functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    # as a lambda's variable the norm is computed once a vector, not once an element
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(F.lit(1.0)))), F.lit(0))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Held to -1..1; with a zero vector 1, so that the distance is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return F.ln(held) - F.log1p(-held)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def evidence(score: Column) -> Column:
    """0 where a score of 0.5 or less saw nothing, up to 1."""
    return clip((score - 0.5) * 2)


def ramp(x: Column, low: float | Column, high: float | Column) -> Column:
    if isinstance(low, Column) or isinstance(high, Column):
        return clip((x - low) / F.when(high - low > 0, high - low).otherwise(F.lit(1e-3)))
    return clip((x - low) / ((high if high > low else low + 1e-3) - low))
