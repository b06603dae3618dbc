"""Trips derived from the events table, and rows that trigger each cleaning rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.config import DEFAULT
from wayspark.functions import geo, seq

#: Axial step of each event type.
STEPS = {"click": (1, 0), "view": (0, 1), "purchase": (-1, 1), "signup": (1, -1), "error": (0, 0)}
WEEK = 604_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip_id, taxi_id, start_epoch, all_cells): each user's events of a week as a
    walk over the grid, in order of time, then id."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.unix_timestamp("ts").alias("sec"))
    step = lambda i: F.coalesce(F.create_map(*[F.lit(x) for k, v in STEPS.items() for x in (k, v[i])])[F.col("event_type")], F.lit(0))
    e = e.withColumn("week", F.floor(F.col("sec") / WEEK)).withColumns({"dq": step(0), "dr": step(1)})
    w = W.partitionBy("user_id", "week").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    at = e.select("user_id", "week", "ts", "event_id", "sec", F.concat(F.sum("dq").over(w).cast("string"), F.lit(","), F.sum("dr").over(w).cast("string")).alias("cell"))
    rows = at.groupBy("user_id", "week").agg(F.min("sec").alias("start_epoch"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "cell"))).alias("s"))
    return rows.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("week").cast("string")).alias("trip_id"), F.col("user_id").alias("taxi_id"), "start_epoch", F.col("s.cell").alias("all_cells"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip_id, taxi_id, start_epoch, cells, duration_sec, distance_km, speed_kmh)."""
    t = walks(spark, sf_dir).select("trip_id", "taxi_id", "start_epoch", seq.dedup(F.col("all_cells")).alias("cells"), ((F.size("all_cells") - 1) * DEFAULT.sample_sec).cast("bigint").alias("duration_sec"))
    km = geo.path_km(F.transform("cells", lambda c: geo.centre(c, DEFAULT.edge(9))))
    t = t.withColumn("distance_km", F.round(km, 4))
    return t.withColumn("speed_kmh", F.when(F.col("duration_sec") > 0, F.round(F.col("distance_km") / (F.col("duration_sec") / 3600.0), 2)).otherwise(0.0))


#: (id, MISSING_DATA, POLYLINE as an expression that both engines read): one row a rule.
RULES = (
    ("T01", "True", "'[[-8.6,41.15],[-8.61,41.15]]'"),
    ("T02", "False", "'[]'"),
    ("T03", "False", "'[[-8.6,41.15],[-8.61'"),
    ("T04", "False", "'[[-8.6,41.15]]'"),
    ("T05", "False", "'[' || repeat('[-8.6,41.15],', 5760) || '[-8.6,41.15]]'"),
    ("T06", "False", "'[[-8.6,41.15],[-9.5,41.15],[-8.6,41.15]]'"),
    ("T07", "False", "'[[-8.6,41.15],[-8.6,41.195],[-8.6,41.15]]'"),
    ("T08", "False", "'[[-8.6,41.15],[-8.6,41.15],[-8.6,41.15],[-8.6,41.15],[-8.6,41.15]]'"),
    ("T09", "False", "'[[-8.6,41.15],[-8.6005,41.15]]'"),
    ("T10", "False", "'[' || repeat('[-8.6,41.15],[-8.6,41.155],', 140) || '[-8.6,41.15]]'"),
    ("T11", "False", "'[[-8.6,41.15],[-8.602,41.15],[-8.604,41.15],[-8.606,41.15],[-8.608,41.15]]'"),
    ("T12", "false", "'[[-8.6,41.15],[-8.602,41.15],[-8.602,41.15],[-8.602,41.15],[-8.604,41.15],[-8.606,41.152]]'"),
    ("T13", "TRUE", "NULL"),
    ("T14", "False", "NULL"),
    ("T15", "False", "''"),
)
RULES_SQL = " UNION ALL ".join(f"SELECT '{i}' AS TRIP_ID, '{m}' AS MISSING_DATA, {p} AS POLYLINE" for i, m, p in RULES)


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips in the nine-column schema: the walks as JSON tracks, some of them
    spoilt by user, and the rule rows."""
    w = walks(spark, sf_dir)
    pts = F.transform("all_cells", lambda c: F.concat(F.lit("["), geo.centre(c, DEFAULT.edge(9))["lng"].cast("string"), F.lit(","), geo.centre(c, DEFAULT.edge(9))["lat"].cast("string"), F.lit("]")))
    line = F.concat(F.lit("["), F.array_join(pts, ","), F.lit("]"))
    u = F.col("taxi_id")
    walked = w.select(
        F.col("trip_id").alias("TRIP_ID"), F.when(u % 3 == 0, "A").when(u % 3 == 1, "B").otherwise("C").alias("CALL_TYPE"), F.lit(None).cast("string").alias("ORIGIN_CALL"),
        F.when(u % 3 == 1, (u % 7).cast("string")).alias("ORIGIN_STAND"), u.cast("int").alias("TAXI_ID"), F.col("start_epoch").alias("TIMESTAMP"), F.lit("A").alias("DAY_TYPE"),
        F.when(u % 41 == 0, "True").otherwise("False").alias("MISSING_DATA"), F.when(u % 43 == 1, "[]").when(u % 47 == 2, F.substring(line, 1, 20)).otherwise(line).alias("POLYLINE"),
    )
    rules = spark.sql(RULES_SQL).select("TRIP_ID", F.lit("C").alias("CALL_TYPE"), F.lit(None).cast("string").alias("ORIGIN_CALL"), F.lit(None).cast("string").alias("ORIGIN_STAND"), F.lit(0).alias("TAXI_ID"), F.lit(0).cast("bigint").alias("TIMESTAMP"), F.lit("A").alias("DAY_TYPE"), "MISSING_DATA", "POLYLINE")
    return walked.unionByName(rules)
