"""Method B: longest frequent repeats, as a group-by over prefixes of suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions import seq

from .gate import frequent, grams


def gated(trips: DataFrame, least: int, most: int, gate_k: int, min_support: int) -> DataFrame:
    """(trip_id, at, suffix): suffixes that begin with a frequent gate_k-gram."""
    suf = trips.select("trip_id", F.posexplode(seq.suffixes(F.col("cells"), least, most)).alias("at", "suffix"))
    head = seq.key(F.slice("suffix", 1, gate_k))
    return suf.withColumn("gram", head).join(frequent(trips, gate_k, min_support).select("gram"), "gram", "left_semi").drop("gram")


def repeats(trips: DataFrame, min_support: int, least: int = 5, most: int = 70, gate_k: int = 4, keep: int | None = None) -> DataFrame:
    """(pattern, support): for every suffix its longest prefix that min_support trips
    hold, by length. Lengths rise one by one and only what is frequent at one length is
    tried at the next, so that no suffix is blown up into all of its prefixes."""
    live = gated(trips, least, most, gate_k, min_support)
    found = None
    for n in range(least, most + 1):
        at = live.where(F.size("suffix") >= n).withColumn("pattern", seq.key(F.slice("suffix", 1, n)))
        freq = at.groupBy("pattern").agg(F.count_distinct("trip_id").alias("support")).where(F.col("support") >= min_support)
        live = at.join(freq, "pattern").checkpoint() if at.sparkSession.sparkContext.getCheckpointDir() else at.join(freq, "pattern").cache()
        if live.isEmpty():
            break
        rows = live.select("trip_id", "at", F.lit(n).alias("n"), "pattern", "support")
        found = rows if found is None else found.unionByName(rows)
        live = live.drop("pattern", "support")
    if found is None:
        return trips.select(F.lit("").alias("pattern"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("support")).limit(0)
    longest = found.groupBy("trip_id", "at").agg(F.max_by(F.struct("pattern", "n", "support"), "n").alias("p")).select("p.*").distinct()
    return longest.orderBy(F.desc("n"), F.desc("support"), "pattern").limit(keep) if keep else longest


def lcp(trips: DataFrame, least: int, most: int, prefix: int = 2) -> DataFrame:
    """(bucket, suffix, lcp): sorted suffixes of a bucket with the length of the prefix
    that each shares with the one before."""
    suf = trips.select("trip_id", F.posexplode(seq.suffixes(F.col("cells"), least, most)).alias("at", "suffix")).withColumn("bucket", seq.key(F.slice("suffix", 1, prefix)))
    prev = F.lag("suffix").over(W.partitionBy("bucket").orderBy(seq.key(F.col("suffix")), "trip_id", "at"))
    same = F.zip_with("suffix", F.coalesce(prev, F.array().cast("array<string>")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return suf.select("bucket", "trip_id", "at", seq.key(F.col("suffix")).alias("suffix"), F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size("suffix")).cast("int").alias("lcp"))
