"""Similarity expressions on arrays and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, lengths that differ and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard on the parts between underscores, at least 0.75 if one name contains the other."""
    plain = jaccard(F.array_distinct(F.split(F.lower(a), "_")), F.array_distinct(F.split(F.lower(b), "_")))
    return F.when(F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a)), F.greatest(plain, F.lit(0.75))).otherwise(plain)
