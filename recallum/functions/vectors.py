"""Vector functions in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either norm is 0, null if either vector is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def parse(text: Column) -> Column:
    """`"[1,2]"` → array<double>; null where empty or not a list."""
    return F.when(F.length(F.trim(text)) > 0, F.from_json(text, "array<double>"))
