"""Array-column arithmetic with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A lambda evaluates everything in it per element, so sums and norms used
    inside one are bound outside through a one-element array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def vsum(v: str | Column) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return vsum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(v: str | Column) -> Column:
    v = col(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(v: str | Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    v = as_double(v)
    return let(F.greatest(norm(v), F.lit(1e-12)), lambda length: F.transform(v, lambda x: x / length))


def centre(v: str | Column) -> Column:
    v = as_double(v)
    return let(vsum(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))


def softmax(v: str | Column, temperature: float | Column = 1.0) -> Column:
    v = as_double(v)
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / t)))
    return let(shifted, normalise_sum)


def normalise_sum(v: str | Column) -> Column:
    v = col(v)
    return let(vsum(v), lambda total: F.transform(v, lambda x: x / total))


def argmax(v: str | Column) -> Column:
    """0-based index of the first largest entry."""
    v = col(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def literal_array(values) -> Column:
    """Constant array<double>; a long one is parsed from text so that it folds into a single literal."""
    values = [float(v) for v in values]
    if len(values) <= 16:
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast("array<double>")
