"""The whole analysis: raw trips in, tables and reports out.

    python -m wayspark.plans.run stage1 RAW_CSV OUT
    python -m wayspark.plans.run stage2 CLEAN_PARQUET OUT
    python -m wayspark.plans.run stage3 ENCODED_PARQUET OUT --x 0.05
    python -m wayspark.plans.run temporal | ridges ENCODED_PARQUET OUT
"""

from __future__ import annotations

import argparse
import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.config import DEFAULT, Params
from wayspark.functions import seq
from wayspark.operators import analysis, clean, corridor, encode, gate, growth, lsh, match, suffix
from wayspark.sources import io


def session(app: str = "wayspark") -> SparkSession:
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def stage1(spark: SparkSession, raw: DataFrame, out: str, p: Params = DEFAULT) -> dict:
    """Clean trips as Parquet, and the cleaning report."""
    io.write_parquet(clean.clean(raw, p), io.join_path(out, "clean"))
    report = clean.report(raw, p)
    io.write_json(spark, io.join_path(out, "cleaning_report.json"), report)
    return report


def stage2(spark: SparkSession, cleaned: DataFrame, out: str, p: Params = DEFAULT) -> dict:
    """Encoded trips as Parquet, and the encoding report."""
    path = io.join_path(out, "encoded")
    io.write_parquet(encode.encode(cleaned, p), path)
    back = io.read_parquet(spark, path)
    lengths = back.agg(F.count("*").alias("trips"), *[F.round(F.avg(f"len_res{r}"), 4).alias(f"mean_len_res{r}") for r, _ in p.edge_km]).first().asDict()
    report = lengths | {f"unique_cells_res{r}": encode.distinct_cells(back, r).first()[0] for r, _ in p.edge_km}
    io.write_json(spark, io.join_path(out, "encoding_report.json"), report)
    return report


def mine(trips: DataFrame, min_support: int, per_method: int = 1333, gate_k: int = 4, window: int = 12, stride: int = 3, least: int = 5, max_suffix: int = 70, beam: int = 600, rounds: int = 45, min_cells: int = 5, p: Params = DEFAULT) -> tuple[DataFrame, dict[str, float]]:
    """(method, corridor, segments, mined_support) of the three methods, valid ones
    only, the longest of each method, and the seconds that each took."""
    took: dict[str, float] = {}
    schema = "corridor string, segments array<array<string>>, mined_support bigint"

    def timed(name: str, df: DataFrame) -> DataFrame:
        began = time.time()
        kept = corridor.valid(corridor.metrics(df), min_cells, p).select("corridor", "segments", "mined_support", "n_cells")
        top = kept.orderBy(F.desc("n_cells"), F.desc("mined_support"), "corridor").limit(per_method).drop("n_cells")
        # of a fixed number of rows
        rows = trips.sparkSession.createDataFrame(top.collect(), schema)
        took[name] = round(time.time() - began, 3)
        return rows.withColumn("method", F.lit(name))

    one = lambda key, sup: (F.col(key).alias("corridor"), F.array(F.split(key, r"\|")).alias("segments"), F.col(sup).alias("mined_support"))
    a = lsh.medoids(trips, min_support, window, stride).select(seq.key(F.col("window")).alias("key"), "mined_support").select(*one("key", "mined_support"))
    b = suffix.repeats(trips, min_support, least, max_suffix, gate_k, keep=6000).select(*one("pattern", "support"))
    c = growth.grow(trips, min_support, gate_k, beam=beam, rounds=rounds, p=p).select("corridor", "segments", F.col("support").alias("mined_support"))
    return timed("lsh", a).unionByName(timed("suffix", b)).unionByName(timed("growth", c)), took


def stage3(spark: SparkSession, encoded: DataFrame, out: str, x: float = 0.05, sweep: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), km: tuple[float, ...] = (1.0, 3.0, 5.0, 10.0), want: int = 100, hole_aware: bool = False, p: Params = DEFAULT, **mining: int) -> dict:
    """Corridors by three methods, verified, compared, and reported; anomalies."""
    trips = encode.load_trips(encoded).cache()
    total = trips.count()
    floor = gate.mining_floor(total, x)
    bench: dict = {"trips": total, "x_pct": x, "min_support": floor}
    began = time.time()
    bench["gate"] = gate.gate_stats(trips, 4, floor).first().asDict()
    bench["gate_sec"] = round(time.time() - began, 3)
    found, bench["method_sec"] = mine(trips, floor, p=p, **mining)
    began = time.time()
    unique = found.select("corridor", "segments").distinct()
    measured = corridor.metrics(found).join(match.verify(trips, unique, p.max_gap), "corridor").where(F.col("support") >= floor).cache()
    bench["verified"] = measured.count()
    bench["verify_sec"] = round(time.time() - began, 3)
    bench["scorecard"] = [r.asDict() for r in corridor.scorecard(measured, km).collect()]
    longest = measured.groupBy("corridor").agg(F.array_sort(F.collect_set("method")).alias("also_found_by"))
    once = measured.dropDuplicates(["corridor"]).join(longest, "corridor")
    kept = corridor.ranked(corridor.without_contained(once, hole_aware))
    pcts = sorted({x, *(s for s in sweep if max(1, math.ceil(total * s / 100)) >= floor)})
    thresholds = spark.createDataFrame([(float(s), max(floor if s == x else 1, math.ceil(total * s / 100))) for s in pcts], "pct double, floor int")
    bench["sweep"] = [r.asDict() for r in corridor.sweep(kept, thresholds, km).orderBy("pct").collect()]
    bench["thresholds"] = [r.asDict() for r in corridor.threshold_choice(kept, thresholds, km, want).orderBy("min_km").collect()]
    bench["length_ceiling"] = [r.asDict() for r in corridor.length_ceiling(trips, km).collect()]
    records = corridor.record(kept, total, p=p).join(kept.select("corridor", "rank", "mined_support", "also_found_by", "mean_duration_sec", "mean_distance_km", "mean_speed_kmh"), "corridor")
    io.write_parquet(records, io.join_path(out, "corridors"))
    top = records.orderBy("rank").limit(want).collect()
    io.write_json(spark, io.join_path(out, "subroutes.json"), {"trips": total, "min_support": floor, "corridors": [r.asDict(True) for r in top]})
    began = time.time()
    scored = analysis.novelty(trips, max(20, int(total * 0.0002))).cache()
    anomalies = {
        "scored": scored.count(),
        "top": [r.asDict() for r in analysis.most_anomalous(scored).collect()],
        "histogram": [r.asDict() for r in analysis.novelty_histogram(scored).orderBy("bin").collect()],
        "low_diversity": [r.asDict() for r in analysis.cell_diversity(trips, 200).orderBy(F.desc("per_taxi"), "cell").limit(50).collect()],
    }
    bench["anomaly_sec"] = round(time.time() - began, 3)
    io.write_json(spark, io.join_path(out, "anomalous_routes.json"), anomalies)
    io.write_json(spark, io.join_path(out, "benchmark.json"), bench | {"provenance": io.provenance(spark)})
    for df in (trips, measured, scored):
        df.unpersist()
    return bench


def temporal(spark: SparkSession, encoded: DataFrame, out: str, min_support: int = 50) -> list[dict]:
    """The busiest 3- and 4-grams of each part of the day."""
    have = "start_epoch" if "start_epoch" in encoded.columns else "TIMESTAMP"
    trips = encode.load_trips(encoded.withColumn("cells", F.col("cells" if "cells" in encoded.columns else "cells_res9")))
    at = encoded.select(F.col("trip_id" if "trip_id" in encoded.columns else "TRIP_ID").alias("trip_id"), F.col(have).alias("start_epoch"))
    rows = [r.asDict() for r in analysis.top_by_part(analysis.temporal_ngrams(trips.join(at, "trip_id"), (3, 4), min_support)).collect()]
    io.write_json(spark, io.join_path(out, "temporal_subroutes.json"), rows)
    return rows


def ridges(spark: SparkSession, encoded: DataFrame, out: str, **limits: int) -> list[dict]:
    rows = analysis.ridges(analysis.elevation(encode.load_trips(encoded)), **limits)
    io.write_json(spark, io.join_path(out, "ridge_routes.json"), rows)
    return rows


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("stage", choices=["stage1", "stage2", "stage3", "temporal", "ridges"])
    a.add_argument("source")
    a.add_argument("out")
    a.add_argument("--x", type=float, default=0.05)
    a.add_argument("--sample", type=float)
    args = a.parse_args()
    spark = session()
    df = io.read_csv(spark, args.source) if args.stage == "stage1" else io.read_parquet(spark, args.source)
    if args.sample:
        df = df.sample(False, args.sample, 42)
    f = {"stage1": stage1, "stage2": stage2, "stage3": stage3, "temporal": temporal, "ridges": ridges}[args.stage]
    f(spark, df, args.out, **({"x": args.x} if args.stage == "stage3" else {}))


if __name__ == "__main__":
    main()
