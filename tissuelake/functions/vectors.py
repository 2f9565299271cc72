"""Algebra of feature vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    length = norm(v) + TINY
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def any_nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def within(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Whether each component of a is near b's: at most atol + rtol * |b| away."""
    return F.size(a) == F.size(b), F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(y.cast("double"))), lambda x: x)


def cls_and_mean(tokens: Column, registers: int = 0) -> Column:
    """A class token joined with the mean of the patch tokens behind it and the registers."""
    rest = F.slice(tokens, 2 + registers, F.greatest(F.size(tokens) - 1 - registers, F.lit(0)))
    width = F.size(F.get(tokens, F.lit(0)))
    sums = F.aggregate(rest, F.array_repeat(F.lit(0.0), width), lambda a, t: F.zip_with(a, t, lambda x, y: x + y.cast("double")))
    return F.concat(F.transform(F.get(tokens, F.lit(0)), lambda x: x.cast("double")), F.transform(sums, lambda x: x / F.size(rest)))
