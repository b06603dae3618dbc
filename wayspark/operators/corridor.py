"""Corridors: ordered contiguous segments, possibly with holes between them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.config import DEFAULT, Params
from wayspark.functions import geo, seq


def _points(cells: Column, edge: float, p: Params) -> Column:
    return F.transform(cells, lambda c: geo.centre(c, edge, p))


def metrics(corridors: DataFrame, edge: float = 0.174, p: Params = DEFAULT) -> DataFrame:
    """corridors (corridor, segments) with their metrics: cells, counts, length with
    holes bridged straight, covered length without, end-to-end distance, tortuosity
    (null where the ends coincide), start and end cell, and validity."""
    flat = F.flatten("segments")
    out = corridors.withColumn("cells", flat).withColumn("__pts", _points(F.col("cells"), edge, p))
    covered = F.aggregate(F.transform("segments", lambda s: geo.path_km(_points(s, edge, p), p)), F.lit(0.0), lambda a, x: a + x)
    first, last = F.get("__pts", F.lit(0)), F.try_element_at("__pts", F.lit(-1))
    out = out.withColumn("length_km", F.when(F.size("cells") > 0, geo.path_km(F.col("__pts"), p)).otherwise(0.0)).withColumn("covered_km", covered)
    out = out.withColumn("end_to_end_km", F.coalesce(geo.haversine(first["lng"], first["lat"], last["lng"], last["lat"], p), F.lit(0.0)))
    out = out.withColumn("tortuosity", F.when(F.col("end_to_end_km") >= 1e-9, F.col("length_km") / F.col("end_to_end_km")))
    return out.withColumns({
        "n_cells": F.size("cells"), "n_segments": F.size("segments"), "n_holes": F.greatest(F.size("segments") - 1, F.lit(0)),
        "start_cell": F.get("cells", F.lit(0)), "end_cell": F.try_element_at("cells", F.lit(-1)),
    }).drop("__pts")


def valid(measured: DataFrame, min_cells: int, p: Params = DEFAULT) -> DataFrame:
    """Corridors of non-empty segments, enough cells, none twice, and not too winding."""
    return measured.where(
        (F.col("n_cells") >= min_cells) & F.forall("segments", lambda s: F.size(s) > 0) & (F.size("segments") > 0) & (F.size(F.array_distinct("cells")) == F.col("n_cells")) & (F.col("tortuosity") <= p.max_tortuosity)
    )


def record(measured: DataFrame, total: int, edge: float = 0.174, p: Params = DEFAULT) -> DataFrame:
    """The serialised corridor: rounded metrics, support share, segment coordinates."""
    coords = F.transform("segments", lambda s: F.transform(s, lambda c: F.struct(c.alias("cell"), F.round(geo.centre(c, edge, p)["lat"], 6).alias("lat"), F.round(geo.centre(c, edge, p)["lng"], 6).alias("lng"))))
    return measured.select(
        "method", "corridor", "segments", F.col("cells").alias("cell_sequence"), "n_segments", "n_cells", "n_holes",
        *[F.round(c, 3).alias(c) for c in ("length_km", "covered_km", "end_to_end_km", "tortuosity")],
        "support", F.round(F.col("support") * 100.0 / F.lit(max(1, total)), 4).alias("support_pct"), "start_cell", "end_cell", coords.alias("segment_coordinates"),
    )


def ranked(measured: DataFrame) -> DataFrame:
    """rank by length, then support, both falling."""
    return measured.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_cells"), F.desc("support"), "corridor")))


def capped(measured: DataFrame, per_method: int) -> DataFrame:
    """At most per_method corridors of each method, longest first."""
    w = W.partitionBy("method").orderBy(F.desc("n_cells"), F.desc("support"), "corridor")
    return measured.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_method).drop("__n")


def contained(measured: DataFrame, hole_aware: bool = False) -> DataFrame:
    """(corridor, host): corridors whose path runs inside a longer one's, with the
    longest host. Paths meet on their first cell. With hole_aware a path must run
    inside one segment of its host."""
    path = F.concat(F.lit("|"), seq.key(F.col("cells")), F.lit("|"))
    inner = measured.select("corridor", "n_cells", "support", path.alias("path"), F.get("cells", F.lit(0)).alias("cell"))
    outer = measured.select(
        F.col("corridor").alias("host"), F.col("n_cells").alias("host_cells"), F.col("support").alias("host_support"), path.alias("host_path"),
        F.transform("segments", lambda s: F.concat(F.lit("|"), seq.key(s), F.lit("|"))).alias("host_segments"), F.explode(F.array_distinct("cells")).alias("cell"),
    )
    longer = F.struct(-F.col("host_cells"), -F.col("host_support"), F.col("host")) < F.struct(-F.col("n_cells"), -F.col("support"), F.col("corridor"))
    holds = F.exists("host_segments", lambda s: s.contains(F.col("path"))) if hole_aware else F.col("host_path").contains(F.col("path"))
    pairs = inner.join(outer, "cell").where(longer & holds)
    return pairs.groupBy("corridor").agg(F.min(F.struct((-F.col("host_cells")).alias("c"), (-F.col("host_support")).alias("s"), "host")).alias("h")).select("corridor", "h.host")


def without_contained(measured: DataFrame, hole_aware: bool = False) -> DataFrame:
    """Corridors that no longer one holds. Holding is transitive, so that the longest
    host of a path is never itself dropped for a path that then reappears."""
    hosts = contained(measured, hole_aware).select(F.col("corridor").alias("__inner"), "host")
    return measured.join(hosts, F.col("corridor") == F.col("__inner"), "left").where("host IS NULL").drop("__inner", "host")


def prune_overlapping(rows: Iterable[dict], max_overlap: float, keep: int) -> list[dict]:
    """Greedy choice from rows in order: one that shares more than max_overlap of the
    smaller cell set with a chosen one goes. Rows are read until `keep` are chosen."""
    chosen: list[tuple[set, dict]] = []
    for row in rows:
        mine = {c for s in row["segments"] for c in s}
        if all(len(mine & other) <= max_overlap * min(len(mine), len(other)) for other, _ in chosen):
            chosen.append((mine, row))
            if len(chosen) >= keep:
                break
    return [r for _, r in chosen]


# -- reports ------------------------------------------------------------------


def scorecard(found: DataFrame, km: tuple[float, ...] = (1.0, 3.0, 5.0)) -> DataFrame:
    """One row by method: counts, lengths, supports, holes, overstatement."""
    over = F.when(F.sum("support") > 0, F.round((F.sum("mined_support") - F.sum("support")) * 100.0 / F.sum("support"), 1)).otherwise(0.0)
    return found.groupBy("method").agg(
        F.count("*").alias("n"), F.round(F.max("length_km"), 3).alias("max_km"), F.round(F.avg("length_km"), 3).alias("mean_km"), F.round(F.avg("n_cells"), 2).alias("mean_cells"),
        F.max("support").alias("max_support"), F.round(F.avg("support"), 2).alias("mean_support"), F.count_if(F.col("n_holes") > 0).alias("with_holes"),
        F.round(F.avg("tortuosity"), 3).alias("mean_tortuosity"), over.alias("overstated_pct"), *[F.count_if(F.col("length_km") >= d).alias(f"ge_{int(d)}km") for d in km],
    )


def sweep(found: DataFrame, thresholds: DataFrame, km: tuple[float, ...] = (1.0, 3.0, 5.0)) -> DataFrame:
    """By threshold (pct, floor): corridors of at least that support. thresholds is a
    report's handful of rows."""
    hit = F.col("support") >= F.col("floor")
    return F.broadcast(thresholds).join(found, hit, "left").groupBy("pct", "floor").agg(
        F.count("support").alias("n"), F.round(F.max("length_km"), 3).alias("max_km"), F.round(F.avg("length_km"), 3).alias("mean_km"), *[F.count_if(F.col("length_km") >= d).alias(f"ge_{int(d)}km") for d in km]
    )


def threshold_choice(found: DataFrame, thresholds: DataFrame, km: tuple[float, ...], want: int) -> DataFrame:
    """By distance: the highest threshold that still leaves `want` corridors, or else
    the lowest threshold, and whether the target was met."""
    spark = found.sparkSession
    d = spark.createDataFrame([(float(x),) for x in km], "min_km double")
    counts = d.join(F.broadcast(thresholds)).join(found, (F.col("length_km") >= F.col("min_km")) & (F.col("support") >= F.col("floor")), "left").groupBy("min_km", "pct", "floor").agg(F.count("support").alias("n"))
    best = F.max(F.when(F.col("n") >= want, F.struct("pct", "floor", "n")))
    least = F.min(F.struct("pct", "floor", "n"))
    return counts.groupBy("min_km").agg(F.coalesce(best, least).alias("b"), best.isNotNull().alias("met_target")).select("min_km", "b.pct", "b.floor", "b.n", "met_target")


def length_ceiling(trips: DataFrame, km: tuple[float, ...]) -> DataFrame:
    """How many trips are at least each length, in one pass."""
    cols = F.array(*[F.struct(F.lit(float(d)).alias("min_km"), F.count_if(F.col("distance_km") >= d).alias("trips")) for d in km])
    return trips.agg(cols.alias("a")).select(F.inline("a"))
