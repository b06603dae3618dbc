"""Frequent k-grams: exact supports, with an optional Count-Min prefilter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspark.functions import seq, sketch


def mining_floor(total: int, pct: float) -> int:
    return max(5, math.ceil(total * pct / 100))


def grams(trips: DataFrame, k: int) -> DataFrame:
    """(trip_id, gram): each trip's distinct k-grams."""
    return trips.select("trip_id", F.explode(seq.distinct_ngrams(F.col("cells"), k)).alias("gram"))


def ngram_support(trips: DataFrame, k: int) -> DataFrame:
    """(gram, support): distinct trips that hold each k-gram. Trip ids are unique, so
    the distinct grams of a trip can be counted without a second shuffle."""
    return grams(trips, k).groupBy(seq.key(F.col("gram")).alias("gram")).agg(F.count("*").alias("support"))


def frequent(trips: DataFrame, k: int, min_support: int) -> DataFrame:
    return ngram_support(trips, k).where(F.col("support") >= min_support)


def gate(trips: DataFrame, k: int, min_support: int, width: int = 1 << 16, depth: int = 4) -> DataFrame:
    """frequent() behind a sketch: grams whose estimate stays below the floor are
    dropped before the exact count. The sketch is at most width * depth rows, whatever
    the input, and never estimates too low, so that the result is exact."""
    keyed = grams(trips, k).select("trip_id", seq.key(F.col("gram")).alias("gram"))
    table = sketch.cms(keyed, "gram", width, depth)
    busy = table.where(F.col("total") >= min_support).select("row", "bucket")
    for d in range(depth):
        own = busy.where(F.col("row") == d).select(F.col("bucket").alias("__b"))
        keyed = keyed.withColumn("__b", F.pmod(sketch.hash32(F.col("gram"), d), F.lit(width))).join(F.broadcast(own), "__b", "left_semi").drop("__b")
    return keyed.groupBy("gram").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


def gate_stats(trips: DataFrame, k: int, min_support: int) -> DataFrame:
    """One row: streamed and distinct grams, frequent ones, share pruned."""
    s = ngram_support(trips, k)
    return s.agg(
        F.sum("support").alias("streamed"), F.count("*").alias("distinct_grams"), F.count_if(F.col("support") >= min_support).alias("frequent_grams"),
        F.round(F.lit(100.0) * (1 - F.count_if(F.col("support") >= min_support) / F.count("*")), 4).alias("pruned_pct"),
    )


def k_ablation(trips: DataFrame, ks: tuple[int, ...], min_support: int) -> DataFrame:
    """gate_stats by k, with the trips too short for it. One pass over the trips."""
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.transform(seq.distinct_ngrams(F.col("cells"), k), seq.key).alias("g")) for k in ks])
    each = trips.select(F.explode(every).alias("x")).select("x.k", "x.g")
    short = each.groupBy("k").agg(F.count_if(F.size("g") == 0).alias("too_short"))
    per = each.select("k", F.explode("g").alias("gram")).groupBy("k", "gram").agg(F.count("*").alias("support"))
    n = per.groupBy("k").agg(F.count("*").alias("distinct_grams"), F.count_if(F.col("support") >= min_support).alias("frequent_grams"))
    return short.join(n, "k", "left").select("k", "too_short", F.coalesce("distinct_grams", F.lit(0)).alias("distinct_grams"), F.coalesce("frequent_grams", F.lit(0)).alias("frequent_grams"))
