"""Arithmetic on vectors, as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import Str


def _col(c: Str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Str, b: Str) -> Column:
    """The dot product, added up from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Str) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Str, floor: float = 1e-9) -> Column:
    """v at length 1; lengths under floor count as floor."""
    return F.transform(_col(v), lambda x: x / F.greatest(norm(v), F.lit(floor)))


def quantised(v: Str) -> Column:
    """A struct of q, whole numbers from -127 to 127, and s, the scale: v is about q * s. Halves round up, as floor(x + 0.5) does."""
    top = F.array_max(F.transform(_col(v), F.abs))
    scale = F.when(top == 0, 1.0).otherwise(top) / 127
    q = F.transform(_col(v), lambda x: F.greatest(F.least(F.floor(x / scale + 0.5), F.lit(127)), F.lit(-127)).cast("tinyint"))
    return F.struct(q.alias("q"), scale.alias("s"))


def dequantised(q: Str, s: Str) -> Column:
    """The vector of length 1 that q and s stand for."""
    return normalised(F.transform(_col(q), lambda x: x * _col(s)), floor=1e-300)


def pooled(hidden: Str, mask: Str, mode: str) -> Column:
    """One vector of the token vectors `hidden`, by `mask` (1 for tokens): mean, cls (the first) or lasttoken (the last that isn't padding)."""
    if mode == "cls":
        return F.element_at(_col(hidden), 1)
    n = F.aggregate(_col(mask), F.lit(0), lambda s, x: s + x)
    if mode == "lasttoken":
        return F.element_at(_col(hidden), F.greatest(n, F.lit(1)))
    if mode != "mean":
        raise ValueError(f"no pooling {mode!r}")
    zero = F.transform(F.element_at(_col(hidden), 1), lambda x: F.lit(0.0))
    masked = F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x * m))
    total = F.aggregate(masked, zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(n.cast("double"), F.lit(1e-9)))
