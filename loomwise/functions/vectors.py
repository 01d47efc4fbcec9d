"""Vector arithmetic on ``array<double>`` columns with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to norms so that zero vectors stay zero.
TINY = 1e-9


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, added up from the first component to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, length: Column | None = None) -> Column:
    """v over its norm plus TINY; pass the norm as a column of its own, so that it is computed once a row."""
    n = norm(v) if length is None else length
    return F.transform(v, lambda x: x / (n + F.lit(TINY)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of any length; 0 if one is zero."""
    return dot(a, b) / ((norm(a) + F.lit(TINY)) * (norm(b) + F.lit(TINY)))


def fit(v: Column, dims: int) -> Column:
    """Filled up with zeros or cut to ``dims`` components; a null vector becomes zeros."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return F.slice(F.concat(F.coalesce(v, F.array().cast("array<double>")), zeros), 1, dims)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)
