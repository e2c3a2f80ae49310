"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; a zero vector is at distance 1 from everything."""
    return 1.0 - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def mean_vector(c: Column | str) -> Column:
    """Element-wise mean of a vector column as an aggregate with map-side partials."""
    return vector_to_array(Summarizer.mean(array_to_vector(_doubles(c))))
