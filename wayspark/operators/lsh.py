"""Method A: strided windows clustered by MinHash bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions import seq, sketch


def windows(trips: DataFrame, width: int, stride: int) -> DataFrame:
    """(trip_id, start, window, window_id)."""
    return trips.select("trip_id", F.posexplode(seq.windows(F.col("cells"), width, stride)).alias("start", "window")).withColumn("window_id", F.concat("trip_id", F.lit("#"), F.col("start").cast("string")))


def pairs(window: Column) -> Column:
    """Distinct consecutive pairs of a window's cells, in order."""
    return F.array_distinct(F.transform(seq.transitions(window), lambda p: F.array_join(p, ">")))


def shingles(wins: DataFrame) -> DataFrame:
    """(window_id, shingle) of each of a window's pairs."""
    return wins.select("window_id", F.explode(pairs(F.col("window"))).alias("shingle"))


def buckets(trips: DataFrame, width: int, stride: int, n_bands: int, rows: int) -> DataFrame:
    """(band, key, n_trips, n_windows) of the windows' bands."""
    wins = windows(trips, width, stride)
    sig = sketch.minhash(shingles(wins), ["window_id"], "shingle", n_bands * rows)
    keyed = sketch.bands(sig, ["window_id"], rows).join(wins.select("window_id", "trip_id"), "window_id")
    return keyed.groupBy("band", "key").agg(F.count_distinct("trip_id").alias("n_trips"), F.count("*").alias("n_windows"))


def medoids(trips: DataFrame, min_support: int, width: int = 12, stride: int = 3, n_bands: int = 8, rows: int = 4, sample: int = 12, keep: int = 4000) -> DataFrame:
    """(window, mined_support): of each bucket of enough trips, the sampled window that
    is, in sum, most like the others by Jaccard of shingles; equal windows keep the
    largest support. The sample is the first windows by id; the pairs below are at
    most sample squared a bucket, a fixed number."""
    wins = windows(trips, width, stride)
    sig = sketch.minhash(shingles(wins), ["window_id"], "shingle", n_bands * rows)
    keyed = sketch.bands(sig, ["window_id"], rows).join(wins, "window_id")
    busy = keyed.groupBy("band", "key").agg(F.count_distinct("trip_id").alias("n_trips")).where(F.col("n_trips") >= min_support)
    few = keyed.join(busy, ["band", "key"]).withColumn("__n", F.row_number().over(W.partitionBy("band", "key").orderBy("window_id"))).where(F.col("__n") <= sample)
    few = few.withColumn("shingles", pairs(F.col("window")))
    groups = few.groupBy("band", "key", "n_trips").agg(F.array_sort(F.collect_list(F.struct("window_id", "window", "shingles"))).alias("w"))
    like = lambda a, b: F.when(F.size(a) + F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    scored = F.transform("w", lambda x: F.struct((-F.round(F.aggregate("w", F.lit(0.0), lambda s, y: s + like(x["shingles"], y["shingles"])), 9)).alias("cost"), x["window_id"].alias("id"), x["window"].alias("window")))
    best = groups.select("n_trips", F.array_min(scored)["window"].alias("window"))
    return best.groupBy("window").agg(F.max("n_trips").alias("mined_support")).orderBy(F.desc("mined_support"), seq.key(F.col("window"))).limit(keep)
