"""Expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def fit_path(vectors: Column, length: int, pad: Column, mode: str = "after") -> Column:
    """Exactly ``length`` vectors: the first and the last ``length - 1`` of a longer path; a shorter one is padded.

    ``mode`` says where padding goes: before, after, or between the first and the rest.
    """
    kept = F.when(F.size(vectors) > length, F.concat(F.slice(vectors, 1, 1), F.slice(vectors, -(length - 1), length - 1) if length > 1 else F.slice(vectors, 1, 0))).otherwise(vectors)
    fill = F.array_repeat(pad, F.greatest(F.lit(0), F.lit(length) - F.size(kept)))
    if mode == "before":
        return F.concat(fill, kept)
    if mode == "between":
        return F.concat(F.slice(kept, 1, 1), fill, F.slice(kept, 2, length))
    return F.concat(kept, fill)
