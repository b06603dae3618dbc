"""Cleaning raw trips: ordered rules, each row with exactly one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspark.config import DEFAULT, Params
from wayspark.functions import geo, seq
from wayspark.functions.frames import with_once

VERDICTS = ("missing_data", "empty_polyline", "bad_json", "too_few_points", "too_long", "out_of_bbox", "gps_jump", "stationary", "too_short_distance", "too_long_distance", "kept")


def judged(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """raw with coordinates (consecutive repeats removed), num_points_raw, distance_km
    and verdict: the first rule that a trip fails, or kept. The track is parsed once;
    a null, empty or unclosed track has a verdict and never fails the job."""
    line = F.col("POLYLINE")
    parsed = with_once(raw, __pts=F.from_json(line, "array<array<double>>"))
    parsed = with_once(parsed, __all=F.transform("__pts", lambda x: F.struct(F.get(x, 0).alias("lng"), F.get(x, 1).alias("lat"))))
    parsed = with_once(parsed, num_points_raw=F.size("__all"), coordinates=seq.dedup(F.col("__all")))
    parsed = with_once(parsed, __steps=geo.steps(F.col("coordinates"), p))
    parsed = with_once(parsed, distance_km=F.aggregate("__steps", F.lit(0.0), lambda s, x: s + x))
    outside = F.exists("__all", lambda x: (x["lng"] < p.min_lng) | (x["lng"] > p.max_lng) | (x["lat"] < p.min_lat) | (x["lat"] > p.max_lat))
    verdict = (
        F.when(F.upper(F.trim("MISSING_DATA")) == "TRUE", "missing_data")
        .when(line.isNull() | F.trim(line).isin("", "[]"), "empty_polyline")
        .when(F.col("__pts").isNull() | F.exists("__all", lambda x: x["lng"].isNull() | x["lat"].isNull()), "bad_json")
        .when(F.col("num_points_raw") < p.min_points, "too_few_points")
        .when(F.col("num_points_raw") > p.max_points, "too_long")
        .when(outside, "out_of_bbox")
        .when(F.exists("__steps", lambda d: d > p.max_step_km), "gps_jump")
        .when(F.size("coordinates") < 2, "stationary")
        .when(F.col("distance_km") < p.min_km, "too_short_distance")
        .when(F.col("distance_km") > p.max_km, "too_long_distance")
        .otherwise("kept")
    )
    return with_once(parsed, verdict=verdict).drop("__pts", "__all", "__steps")


def clean(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Kept trips with their features."""
    kept = judged(raw, p).where("verdict = 'kept'").drop("verdict", "MISSING_DATA", "POLYLINE")
    return features(kept, p)


def features(kept: DataFrame, p: Params = DEFAULT) -> DataFrame:
    c = F.col("coordinates")
    seconds = (F.col("num_points_raw") - 1) * p.sample_sec
    first, last = c[0], F.element_at(c, -1)
    return kept.select(
        *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("TRIP_ID", "CALL_TYPE", "ORIGIN_CALL", "ORIGIN_STAND", "DAY_TYPE")],
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("TAXI_ID", "TIMESTAMP")],
        "coordinates", F.size(c).alias("num_points"), "num_points_raw", seconds.alias("duration_sec"), F.round("distance_km", 4).alias("distance_km"),
        F.round(first["lng"], 6).alias("start_lng"), F.round(first["lat"], 6).alias("start_lat"), F.round(last["lng"], 6).alias("end_lng"), F.round(last["lat"], 6).alias("end_lat"),
        F.when(seconds > 0, F.round(F.col("distance_km") / (seconds / 3600.0), 2)).otherwise(0.0).alias("avg_speed_kmh"),
        *clock(F.coalesce(F.col("TIMESTAMP"), F.lit(0))),
    )


def clock(epoch: Column) -> list[Column]:
    """Date-time text, hour and day of week (Sunday 1) of epoch seconds, in the
    session's time zone."""
    at = F.timestamp_seconds(epoch)
    return [F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("trip_datetime"), F.hour(at).alias("hour_of_day"), F.dayofweek(at).alias("day_of_week")]


def verdict_counts(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows by verdict with their share of all rows."""
    return judged(raw, p).groupBy("verdict").agg(F.count("*").alias("trips")).withColumn("pct", F.round(F.col("trips") * 100.0 / F.sum("trips").over(_all()), 4))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def report(raw: DataFrame, p: Params = DEFAULT) -> dict:
    """The cleaning report: totals, removals by rule, distribution of distances."""
    counts = {r["verdict"]: r["trips"] for r in verdict_counts(raw, p).collect()}
    total, kept = sum(counts.values()), counts.get("kept", 0)
    q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    s = clean(raw, p).agg(F.count_distinct("TAXI_ID").alias("taxis"), F.max("distance_km").alias("max_km"), F.avg("distance_km").alias("mean_km"), F.percentile_approx("distance_km", q, 10000).alias("q")).first()
    return {"raw_trips": total, "clean_trips": kept, "removed": total - kept, "removed_pct": round(100 * (total - kept) / total, 4) if total else 0.0, "rules": {v: counts.get(v, 0) for v in VERDICTS[:-1]}, "unique_taxis": s["taxis"], "max_km": s["max_km"], "mean_km": s["mean_km"], "distance_quantiles": dict(zip(map(str, q), s["q"] or []))}
