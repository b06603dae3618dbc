"""Anomalies, time-of-day patterns, densities, ridges and exploratory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.config import DEFAULT, Params
from wayspark.functions import geo, seq, sketch

from .gate import frequent

# -- anomalies ----------------------------------------------------------------


def novelty(trips: DataFrame, min_support: int, min_cells: int = 8) -> DataFrame:
    """(trip_id, n_cells, n_rare, novelty): the share of a trip's transitions that too
    few trips make."""
    long = trips.where(F.size("cells") >= min_cells)
    steps = long.select("trip_id", F.size("cells").alias("n_cells"), F.explode(F.transform(seq.transitions(F.col("cells")), seq.key)).alias("gram"))
    known = frequent(trips, 2, min_support).select("gram", F.lit(1).alias("hit"))
    return steps.join(known, "gram", "left").groupBy("trip_id", "n_cells").agg(F.count_if(F.col("hit").isNull()).alias("n_rare"), F.round(F.count_if(F.col("hit").isNull()) / F.count("*"), 4).alias("novelty"))


def most_anomalous(scored: DataFrame, n: int = 100) -> DataFrame:
    return scored.orderBy(F.desc("novelty"), F.desc("n_cells"), "trip_id").limit(n)


def novelty_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.round("novelty", 1).alias("bin")).agg(F.count("*").alias("trips"))


def cell_diversity(trips: DataFrame, min_traversals: int, b: int | None = None) -> DataFrame:
    """(cell, traversals, taxis, per_taxi) of cells that enough trips visit; taxis are
    exact, or estimated from 2^b registers a cell."""
    visits = trips.select("taxi_id", F.explode(F.array_distinct("cells")).alias("cell"))
    n = visits.groupBy("cell").agg(F.count("*").alias("traversals"), F.count_distinct("taxi_id").alias("taxis")) if b is None else visits.groupBy("cell").agg(F.count("*").alias("traversals"))
    if b is not None:
        est = sketch.hll_estimate(sketch.hll(visits.withColumn("taxi", F.col("taxi_id").cast("string")), ["cell"], "taxi", b), ["cell"], b)
        n = n.join(est, "cell").select("cell", "traversals", F.greatest(F.lit(1.0), F.round("estimate")).cast("bigint").alias("taxis"))
    return n.where(F.col("traversals") >= min_traversals).withColumn("per_taxi", F.round(F.col("traversals") / F.col("taxis"), 4))


# -- time of day --------------------------------------------------------------


def day_part(hour: Column) -> Column:
    """morning 7 to 10, evening 16 to 19, night 23 to 4, ends included; else null."""
    return F.when(hour.between(7, 10), "morning").when(hour.between(16, 19), "evening").when((hour >= 23) | (hour <= 4), "night")


def temporal_ngrams(trips: DataFrame, ks: tuple[int, ...], min_support: int) -> DataFrame:
    """(part, k, gram, support, avg_duration_sec, avg_distance_km, avg_speed_kmh) of
    the runs of k cells by part of the day; support counts occurrences."""
    def tagged(k: int) -> Column:
        return F.transform(seq.ngrams(F.col("cells"), k), lambda g: F.struct(F.lit(k).alias("k"), seq.key(g).alias("gram")))

    runs = F.concat(*[tagged(k) for k in ks])
    rows = trips.withColumn("part", day_part(F.hour(F.timestamp_seconds("start_epoch")))).where("part IS NOT NULL").select("part", "duration_sec", "distance_km", F.explode(runs).alias("g"))
    agg = rows.groupBy("part", "g.k", "g.gram").agg(F.count("*").alias("support"), F.round(F.sum("duration_sec") / F.count("*"), 1).alias("avg_duration_sec"), F.round(F.sum("distance_km") / F.count("*"), 3).alias("avg_distance_km"))
    speed = F.when(F.col("avg_duration_sec") > 0, F.round(F.round(F.col("avg_distance_km") / (F.col("avg_duration_sec") / 3600.0), 6), 2)).otherwise(0.0)
    return agg.where(F.col("support") >= min_support).withColumn("avg_speed_kmh", speed)


def top_by_part(grams: DataFrame, n: int = 10) -> DataFrame:
    w = W.partitionBy("part").orderBy(F.desc("support"), F.desc("k"), "gram")
    return grams.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# -- density and ridges -------------------------------------------------------


def cell_counts(trips: DataFrame) -> DataFrame:
    return trips.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("visits"))


def smoothed(counts: DataFrame, own: float = 0.6, each: float = 0.066) -> DataFrame:
    """Density with a share of each cell's count on its six neighbours."""
    spread = F.concat(F.array(F.struct(F.col("cell").alias("cell"), F.lit(own).alias("w"))), F.transform(geo.ring(F.col("cell")), lambda c: F.struct(c.alias("cell"), F.lit(each).alias("w"))))
    return counts.select("visits", F.explode(spread).alias("s")).groupBy("s.cell").agg(F.round(F.sum(F.col("visits") * F.col("s.w")), 4).alias("density"))


def heights(counts: DataFrame, top: int, metres: float) -> DataFrame:
    """The busiest cells with their share of the largest count, and a height."""
    few = counts.orderBy(F.desc("visits"), "cell").limit(top)
    norm = F.round(F.col("visits") / F.max("visits").over(W.partitionBy()), 4)
    return few.withColumn("norm", norm).withColumn("height_m", F.round(F.col("norm") * metres, 2))


def stacked(fine: DataFrame, coarse: DataFrame, edge: float, coarser: float, default: float = 0.0, p: Params = DEFAULT) -> DataFrame:
    """fine heights with base_m, the height of the coarse cell below, or the default."""
    base = coarse.select(F.col("cell").alias("parent"), F.col("height_m").alias("base_m"))
    return fine.withColumn("parent", geo.parent(F.col("cell"), edge, coarser, p)).join(base, "parent", "left").withColumn("base_m", F.coalesce("base_m", F.lit(default)))


def elevation(trips: DataFrame) -> DataFrame:
    """(cell, elevation): 2 for each trip that visits a cell, and 1 for each visited
    neighbour of a cell that the trip doesn't visit."""
    t = trips.select(F.array_distinct("cells").alias("c"))
    near = F.filter(F.flatten(F.transform("c", geo.ring)), lambda x: ~F.array_contains("c", x))
    both = F.concat(F.transform("c", lambda x: F.struct(x.alias("cell"), F.lit(2).alias("w"))), F.transform(near, lambda x: F.struct(x.alias("cell"), F.lit(1).alias("w"))))
    return t.select(F.explode(both).alias("e")).groupBy("e.cell").agg(F.sum("e.w").alias("elevation"))


def ridges(field: DataFrame, peaks: int = 5000, routes: int = 100, first_cap: int = 150, cap: int = 300, stop: float = 0.05, min_cells: int = 15) -> list[dict]:
    """Greedy walks along the crest: from each unused peak both ways to the highest
    unused neighbour, until it falls below a share of the peak. Walks use up their
    cells even if they are too short to report. The walk is sequential, so it runs on
    the driver over the whole field, one row a cell: its size is that of the region at a
    resolution, and doesn't grow with the trips."""
    rows = field.orderBy(F.desc("elevation"), "cell").collect()
    height = {tuple(map(int, r["cell"].split(","))): r["elevation"] for r in rows}
    used: set[tuple[int, int]] = set()
    out: list[dict] = []

    def walk(start, limit, least):
        path, at = [], start
        while len(path) < limit:
            near = [(at[0] + dq, at[1] + dr) for dq, dr in geo.RING]
            near = [c for c in near if c in height and c not in used]
            if not near:
                break
            best = max(near, key=lambda c: (height[c], (-c[0], -c[1])))
            if height[best] < least:
                break
            used.add(best)
            path.append(best)
            at = best
        return path

    for r in rows[:peaks]:
        c = tuple(map(int, r["cell"].split(",")))
        if c in used:
            continue
        used.add(c)
        ahead = walk(c, first_cap, stop * height[c])
        back = walk(c, cap - len(ahead), stop * height[c])
        path = [*reversed(back), c, *ahead]
        if len(path) > min_cells:
            out.append({"cells": [f"{q},{s}" for q, s in path], "n_cells": len(path), "peak": height[c], "avg_elevation": round(sum(height[x] for x in path) / len(path), 2)})
            if len(out) >= routes:
                break
    return sorted(out, key=lambda x: -x["avg_elevation"])


def ridges_by_length(spark: SparkSession, routes: list[dict], edge: float, km: tuple[float, ...], most: int = 100, p: Params = DEFAULT) -> DataFrame:
    """(least_km, rank, n_cells, length_km, avg_elevation, peak, cells): for each length,
    the first `most` ridges that are as long, in the order of ridges()."""
    rows = [(i + 1, r["n_cells"], r["avg_elevation"], int(r["peak"]), r["cells"]) for i, r in enumerate(routes)]
    df = spark.createDataFrame(rows, "rank int, n_cells int, avg_elevation double, peak int, way array<string>")
    df = df.withColumn("length_km", F.round(geo.path_km(F.transform("way", lambda c: geo.centre(c, edge, p)), p), 3))
    df = df.withColumn("least_km", F.explode(F.array(*[F.lit(float(x)) for x in km]))).where("length_km >= least_km")
    first = df.withColumn("__n", F.row_number().over(W.partitionBy("least_km").orderBy("rank"))).where(F.col("__n") <= most)
    return first.select("least_km", "rank", "n_cells", "length_km", "avg_elevation", "peak", F.array_join("way", "|").alias("cells"))


# -- exploratory tables -------------------------------------------------------


def value_counts(df: DataFrame, col: str, domain: list | None = None) -> DataFrame:
    """Counts by value; with a domain, its missing values count 0."""
    n = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    if domain is None:
        return n
    every = df.sparkSession.createDataFrame([(v,) for v in domain], f"value {df.schema[col].dataType.simpleString()}")
    return every.join(n, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """(bin, n): right-closed bins between edges; values at or below the first or above
    the last edge are in none; empty bins count 0."""
    place = F.expr("CASE " + " ".join(f"WHEN {col} > {a} AND {col} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END")
    n = df.select(place.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def describe(df: DataFrame, col: str) -> DataFrame:
    q = F.percentile(col, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.99)]))
    s = df.agg(F.count(col).alias("n"), F.round(F.avg(col), 4).alias("mean"), F.round(F.stddev(col), 4).alias("std"), F.min(col).alias("least"), F.max(col).alias("most"), q.alias("q"))
    return s.select("n", "mean", "std", "least", "most", *[F.round(F.col("q")[i], 4).alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90, 99))])


def per_actor(trips: DataFrame, top: int = 5) -> DataFrame:
    return trips.groupBy("taxi_id").agg(F.count("*").alias("trips"), F.round(F.sum("distance_km"), 3).alias("km"), F.round(F.avg("speed_kmh"), 3).alias("mean_kmh")).orderBy(F.desc("trips"), "taxi_id").limit(top)
