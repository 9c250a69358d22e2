"""Scalar expressions that the operators share. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def fixed(x: Column, places: int = 6) -> Column:
    """Rounds half up by one IEEE expression, so that any engine gives the same double. The half is a little more than a
    half, so that sums made in another order don't fall on either side of a tie."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5001).cast("double") / scale


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between the bounds; null stays null (greatest and least would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def saturate(x: Column, scale: float) -> Column:
    """0 up to 0, then x / (x + scale)."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(x / (x + F.lit(scale)))


def decay(x: Column, scale: float) -> Column:
    return F.exp(-x / F.lit(scale))


def weighted(terms: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the terms that are not null; their weights are scaled to sum to 1."""
    zero = F.lit(0.0)
    top = sum((F.coalesce(value * F.lit(weight), zero) for value, weight in terms.values()), zero)
    bottom = sum((F.when(value.isNotNull(), F.lit(weight)).otherwise(zero) for value, weight in terms.values()), zero)
    return F.when(bottom > 0, top / bottom).otherwise(zero)


def ease(t: Column, kind: str) -> Column:
    """linear, in, out, or in_out (smooth step), with t clamped to [0, 1]."""
    u = clamp(t)
    return {"linear": u, "in": u * u, "out": F.lit(1.0) - (F.lit(1.0) - u) * (F.lit(1.0) - u),
            "in_out": u * u * (F.lit(3.0) - F.lit(2.0) * u)}[kind]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, component by component."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for missing vectors, different lengths, or a norm up to 1e-9."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (na > EPS) & (nb > EPS)
    return F.when(fine, dot(a, b) / (na * nb))


def first_tag(tags: Column, name: str) -> Column:
    """What follows ``name:`` in the first tag that starts so."""
    found = F.filter(tags, lambda tag: tag.startswith(f"{name}:"))
    return F.substring_index(F.try_element_at(found, F.lit(1)), ":", -1)


def file_name(raw: Column, default: str = "upload") -> Column:
    """The last path component, with runs of other characters as one underscore, and no dots or underscores at either end."""
    base = F.regexp_extract(raw, r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit(default))
