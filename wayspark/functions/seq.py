"""Sequences as Spark columns; none of these shuffles or leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dedup(a: Column) -> Column:
    """Without elements equal to the one before. Neighbours are zipped, as an index
    into `a` inside a lambda would evaluate `a` anew for each element."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(a, 2, n), F.slice(a, 1, n), lambda x, before: F.struct(x.alias("x"), x.eqNullSafe(before).alias("same")))
    return F.concat(F.slice(a, 1, 1), F.transform(F.filter(pairs, lambda p: ~p["same"]), lambda p: p["x"]))


def ngrams(a: Column, k: int) -> Column:
    """All runs of k elements, in order; none if the sequence is shorter."""
    return F.transform(_starts(a, k), lambda i: F.slice(a, i, k))


def _starts(a: Column, k: int, stride: int = 1) -> Column:
    n = F.size(a)
    none = F.array().cast("array<int>")
    return F.when(n >= k, F.sequence(F.lit(1), n - k + 1, F.lit(stride))).otherwise(none)


def distinct_ngrams(a: Column, k: int) -> Column:
    return F.array_distinct(ngrams(a, k))


def windows(a: Column, width: int, stride: int) -> Column:
    return F.transform(_starts(a, width, stride), lambda i: F.slice(a, i, width))


def transitions(a: Column) -> Column:
    return ngrams(a, 2)


def suffixes(a: Column, least: int, most: int) -> Column:
    """Suffixes of at least `least` elements, cut to `most`."""
    return F.transform(_starts(a, least), lambda i: F.slice(a, i, most))


def key(a: Column) -> Column:
    return F.array_join(a, "|")


def first_at(a: Column, pattern: Column, start: Column) -> Column:
    """First 1-based position from start at which pattern stands in a, or null."""
    m = F.size(pattern)
    places = F.when(F.size(a) >= start + m - 1, F.sequence(start, F.size(a) - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(places, lambda i: F.slice(a, i, m) == pattern), F.lit(0))
