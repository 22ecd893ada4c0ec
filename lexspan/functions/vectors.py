"""Vector functions as columns over arrays of double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def clamped_cosine(a: Column, b: Column) -> Column:
    return F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0))


def closeness(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance)."""
    return F.lit(1.0) / (1.0 + norm(F.zip_with(a, b, lambda x, y: x - y)))


def similarity(a: Column, b: Column, distance: str = "cosine") -> Column:
    return {"cosine": cosine, "dot": dot, "euclid": closeness}[distance](a, b)


def matches_profile(v: Column, dimensions: int, unit: bool = True, within: float = 1e-3) -> Column:
    """The stated number of finite components, and length one if the profile says so."""
    ok = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return ok & (F.abs(norm(v) - 1.0) <= within) if unit else ok


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term counts of two arrays of terms; 0 if either is empty."""
    terms = F.array_union(a, b)
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t)).cast("double")
    return cosine(F.transform(terms, lambda t: count(a, t)), F.transform(terms, lambda t: count(b, t)))
