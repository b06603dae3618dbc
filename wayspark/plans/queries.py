"""One query for each operator, over relations derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.config import DEFAULT as P
from wayspark.functions import geo, seq, sketch
from wayspark.operators import analysis, clean, corridor, encode, gate, growth, lsh, match, suffix
from wayspark.sources import io

from .fixtures import raw_trips, table, trips
from .oracles import BK, BM, CD, CW, HB, KM, KM_EDGES, MIN_EDGES, ORACLE_SQL, THRESHOLDS

__all__ = ["ORACLE_SQL", "QUERIES", "frequent_ngrams"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = seq.key


def query(name: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        return f

    return add


def frequent_ngrams(spark: SparkSession, sf_dir: str, k: int = 4, min_support: int = 5) -> DataFrame:
    return gate.frequent(trips(spark, sf_dir), k, min_support)


# -- sources and sinks --------------------------------------------------------


@query("src1_csv_scan")
def _(spark, d):
    path = io.scratch(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).option("escape", '"').csv(path)
    return io.read_csv(spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint")


@query("src3_parquet_pruned_scan")
def _(spark, d):
    return io.read_parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_orderstatus"]).where("o_orderstatus = 'F'")


@query("src8_fixed_sample")
def _(spark, d):
    return io.sample_rows(table(spark, d, "customer"), 50, "c_custkey").select("c_custkey", "c_name")


@query("src7_bernoulli_sample")
def _(spark, d):
    return encode.load_trips(trips(spark, d), 0.25).select("trip_id")


@query("src10_load_trips")
def _(spark, d):
    return encode.load_trips(trips(spark, d)).select("trip_id", F.size("cells").cast("bigint").alias("n_cells"), "taxi_id", "duration_sec", "distance_km")


@query("src11_json_polylines")
def _(spark, d):
    path = io.scratch(spark)
    out = corridor.record(measured(spark, d), 1)
    out.select("corridor", "segment_coordinates").write.json(path)
    back = io.read_json(spark, path, "corridor string, segment_coordinates array<array<struct<cell:string,lat:double,lng:double>>>", multiline=False)
    return io.polylines(back, 4).select("corridor", F.size("points").cast("bigint").alias("n_points"))


@query("snk1_parquet_round_trip")
def _(spark, d):
    path = io.scratch(spark)
    io.write_parquet(trips(spark, d).select("trip_id", "distance_km"), path)
    return io.read_parquet(spark, path)


@query("snk3_cleaning_report")
def _(spark, d):
    path = io.join_path(io.scratch(spark), "report.json")
    io.write_json(spark, path, clean.report(raw_trips(spark, d)))
    return io.read_json(spark, path).select("raw_trips", "clean_trips", "removed", "removed_pct", "unique_taxis", F.to_json("rules").alias("rules"))


# -- cleaning and encoding ----------------------------------------------------


@query("flt1_10_verdicts")
def _(spark, d):
    return clean.judged(raw_trips(spark, d)).select("TRIP_ID", "verdict")


@query("flt11_verdict_counts")
def _(spark, d):
    return clean.verdict_counts(raw_trips(spark, d))


@query("prj1_9_features")
def _(spark, d):
    return clean.clean(raw_trips(spark, d)).drop("coordinates", "TIMESTAMP", "ORIGIN_CALL", "DAY_TYPE")


def _encoded(spark, d):
    return encode.encode(clean.clean(raw_trips(spark, d)))


for _res in (8, 9, 10):

    @query(f"prj10_encode_res{_res}")
    def _(spark, d, res=_res):
        return _encoded(spark, d).select("TRIP_ID", KEY(F.col(f"cells_res{res}")).alias("cells"), F.col(f"start_res{res}").alias("start_cell"), F.col(f"end_res{res}").alias("end_cell"), F.col(f"len_res{res}").cast("bigint").alias("n_cells"))


@query("agg2_distinct_cells")
def _(spark, d):
    every = F.array(*[F.struct(F.lit(r).alias("res"), F.col(f"cells_res{r}").alias("cells")) for r in (8, 9, 10)])
    return _encoded(spark, d).select(F.explode(every).alias("e")).select("e.res", F.explode("e.cells").alias("cell")).groupBy("res").agg(F.count_distinct("cell").alias("n_cells"))


@query("agg1_6_stage_stats")
def _(spark, d):
    c = clean.clean(raw_trips(spark, d))
    return c.agg(F.count("*").alias("n"), F.count_distinct("TAXI_ID").alias("taxis"), F.max("distance_km").alias("max_km"), F.round(F.avg(F.col("num_points") / F.col("num_points_raw")), 6).alias("mean_ratio"))


@query("agg5_approx_quantiles")
def _(spark, d):
    return trips(spark, d).agg(F.percentile_approx("distance_km", [0.01, 0.25, 0.5, 0.75, 0.99], 10000).alias("q")).select(F.posexplode("q").alias("i", "km"))


def _cells(spark, d):
    return trips(spark, d).select(F.explode("cells").alias("cell")).distinct()


@query("prj12_cell_centres")
def _(spark, d):
    c = geo.centre(F.col("cell"), P.edge(9))
    return _cells(spark, d).select("cell", F.round(c["lng"], 6).alias("lng"), F.round(c["lat"], 6).alias("lat"))


@query("prj13_boundaries")
def _(spark, d):
    b = _cells(spark, d).select("cell", F.posexplode(geo.boundary(F.col("cell"), P.edge(9))).alias("i", "p"))
    return b.select("cell", F.col("i").cast("bigint").alias("i"), F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"))


@query("prj14_parents")
def _(spark, d):
    return _cells(spark, d).select(F.col("cell").alias("child"), geo.parent(F.col("cell"), P.edge(9), P.edge(8)).alias("parent"))


@query("prj15_rings")
def _(spark, d):
    return _cells(spark, d).select("cell", F.explode(geo.ring(F.col("cell"))).alias("neighbour"))


@query("prj16_grid_distance")
def _(spark, d):
    return trips(spark, d).select("trip_id", geo.grid_distance(F.col("cells")[0], F.element_at("cells", -1)).alias("hops"))


@query("prj16_grid_bridge")
def _(spark, d):
    a, b = F.col("cells")[0], F.element_at("cells", -1)
    return trips(spark, d).select("trip_id", geo.grid_path(a, b).alias("path"), geo.bridge(a, b).alias("bridge"))


# -- k-grams, sketches --------------------------------------------------------

for _k in (2, 3, 4, 5):

    @query(f"agg7_ngram_support_k{_k}")
    def _(spark, d, k=_k):
        return gate.ngram_support(trips(spark, d), k)


@query("min1_frequent_gate")
def _(spark, d):
    return gate.gate(trips(spark, d), 4, 5, CW, CD)


@query("agg36_gate_stats")
def _(spark, d):
    return gate.gate_stats(trips(spark, d), 4, 5)


@query("agg33_k_ablation")
def _(spark, d):
    return gate.k_ablation(trips(spark, d), (2, 3, 4, 6), 5)


def _grams(spark, d, k=4):
    return gate.grams(trips(spark, d), k).select("trip_id", KEY(F.col("gram")).alias("gram"))


@query("agg8_cms_table")
def _(spark, d):
    return sketch.cms(_grams(spark, d), "gram", CW, CD)


@query("jn7_cms_estimates")
def _(spark, d):
    g = _grams(spark, d)
    return sketch.cms_estimate(sketch.cms(g, "gram", CW, CD), g.select("gram").distinct(), "gram", CW, CD)


@query("agg8_cms_never_under")
def _(spark, d):
    g = _grams(spark, d)
    true = g.groupBy("gram").agg(F.count("*").alias("n"))
    est = sketch.cms_estimate(sketch.cms(g, "gram", CW, CD), true, "gram", CW, CD)
    return est.join(true, "gram").agg(F.count_if(F.col("estimate") < F.col("n")).cast("int").alias("underestimates"))


@query("agg10_bloom_bits")
def _(spark, d):
    return sketch.bloom(frequent_ngrams(spark, d), "gram", BM, BK)


@query("jn4_bloom_membership")
def _(spark, d):
    return sketch.bloom_test(sketch.bloom(frequent_ngrams(spark, d), "gram", BM, BK), _grams(spark, d), "gram", BM, BK)


@query("agg10_bloom_no_false_negatives")
def _(spark, d):
    f = frequent_ngrams(spark, d)
    return sketch.bloom_test(sketch.bloom(f, "gram", BM, BK), f, "gram", BM, BK).agg(F.count_if(~F.col("maybe")).cast("int").alias("false_negatives"))


def _taxi_cells(spark, d):
    return trips(spark, d).select(F.explode("cells").alias("cell"), F.col("taxi_id").cast("string").alias("taxi"))


@query("agg11_hll_registers")
def _(spark, d):
    return sketch.hll(_taxi_cells(spark, d), ["cell"], "taxi", HB)


@query("agg11_hll_estimates")
def _(spark, d):
    found = sketch.hll_estimate(sketch.hll(_taxi_cells(spark, d), ["cell"], "taxi", HB), ["cell"], HB)
    return found.select("cell", F.round("estimate", 6).alias("estimate"))


@query("agg12_distinct_counter")
def _(spark, d):
    exact = F.count_distinct("taxi")
    few = _taxi_cells(spark, d).groupBy("cell").agg(exact.alias("n")).where("n <= 64").select("cell")
    return sketch.distinct_count(_taxi_cells(spark, d), ["cell"], "taxi", HB).join(few, "cell")


@query("agg12_distinct_counter_all_cells")
def _(spark, d):
    """Every cell, the estimated ones too; agg12_distinct_counter's SQL has the exact ones only."""
    found = sketch.distinct_count(_taxi_cells(spark, d), ["cell"], "taxi", HB)
    return found.select("cell", F.round("n_distinct", 6).alias("n_distinct"))


@query("agg11_hll_merged")
def _(spark, d):
    """Registers of two halves of the trips, merged."""
    rows = trips(spark, d).select("trip_id", F.explode("cells").alias("cell"), F.col("taxi_id").cast("string").alias("taxi"))
    odd = F.pmod(F.xxhash64("trip_id"), F.lit(2)) == 1
    halves = [sketch.hll(rows.where(x), ["cell"], "taxi", HB) for x in (odd, ~odd)]
    return sketch.hll_merge(*halves)


@query("agg10_bloom_merged")
def _(spark, d):
    """Bits of two halves of the frequent grams, merged."""
    g = gate.frequent(trips(spark, d), 4, 5).select("gram")
    odd = F.pmod(F.xxhash64("gram"), F.lit(2)) == 1
    return sketch.bloom(g.where(odd), "gram", BM, BK).union(sketch.bloom(g.where(~odd), "gram", BM, BK)).distinct()


@query("agg9_cms_errors")
def _(spark, d):
    """How far the Count-Min estimates of the 3-grams are above their counts."""
    g = _grams(spark, d, 3)
    true = g.groupBy("gram").agg(F.count("*").alias("n"))
    est = sketch.cms_estimate(sketch.cms(g, "gram", CW, CD), true.select("gram"), "gram", CW, CD)
    off = est.join(true, "gram").select((F.col("estimate") - F.col("n")).alias("off"), "n")
    return off.agg(F.count("*").alias("keys"), F.count_if(F.col("off") > 0).alias("over"), F.max("off").alias("most"), F.sum("off").alias("total"), F.sum("n").alias("items"))


@query("set6_merged_sketch")
def _(spark, d):
    g = _grams(spark, d, 3)
    odd = F.pmod(F.xxhash64("trip_id"), F.lit(2)) == 1
    return sketch.cms_merge(sketch.cms(g.where(odd), "gram", CW, CD), sketch.cms(g.where(~odd), "gram", CW, CD))


@query("agg9_sketch_sizing")
def _(spark, d):
    (w, n), (m, k) = sketch.cms_shape(0.001, 0.01), sketch.bloom_shape(1000, 0.01)
    return spark.createDataFrame([(w, n, sketch.cms_budget(32, 4), m, k)], "width int, depth int, budget_width int, bloom_bits int, bloom_hashes int")


# -- sequences ----------------------------------------------------------------


def _count(df: DataFrame, grams) -> DataFrame:
    return df.select(F.explode(F.transform(grams, KEY)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("seq2_all_ngrams")
def _(spark, d):
    return _count(trips(spark, d), seq.ngrams(F.col("cells"), 3))


@query("seq6_transitions")
def _(spark, d):
    return _count(trips(spark, d), seq.transitions(F.col("cells")))


@query("seq3_windows")
def _(spark, d):
    return lsh.windows(trips(spark, d), 6, 3).select("window_id", KEY(F.col("window")).alias("win"))


@query("seq4_shingles")
def _(spark, d):
    return lsh.shingles(lsh.windows(trips(spark, d), 6, 3))


@query("seq5_suffixes")
def _(spark, d):
    return trips(spark, d).select("trip_id", F.posexplode(seq.suffixes(F.col("cells"), 5, 70)).alias("beg", "s")).select("trip_id", "beg", KEY(F.col("s")).alias("suffix"))


@query("jn4_gated_suffixes")
def _(spark, d):
    return suffix.gated(trips(spark, d), 5, 70, 4, 5).select("trip_id", F.col("at").alias("beg"), KEY(F.col("suffix")).alias("suffix"))


@query("win1_lcp")
def _(spark, d):
    return suffix.lcp(trips(spark, d), 5, 70)


@query("seq7_cells_by_taxi")
def _(spark, d):
    v = trips(spark, d).select("taxi_id", F.explode(F.array_distinct("cells")).alias("cell"))
    return v.groupBy("cell").agg(F.count("*").alias("traversals"), F.count_distinct("taxi_id").alias("taxis"))


@query("seq12_first_occurrence")
def _(spark, d):
    t = trips(spark, d).where(F.array_contains("cells", "0,1"))
    return t.select("trip_id", seq.first_at(F.col("cells"), F.array(F.lit("0,1")), F.lit(1)).alias("beg"))


@query("min2_minhash")
def _(spark, d):
    return sketch.minhash(lsh.shingles(lsh.windows(trips(spark, d), 6, 3)), ["window_id"], "shingle", 8)


@query("min3_lsh_buckets")
def _(spark, d):
    return lsh.buckets(trips(spark, d), 6, 3, 4, 2)


@query("set5_jaccard")
def _(spark, d):
    w = lsh.windows(trips(spark, d), 6, 3)
    a, b = w.alias("a"), w.alias("b")
    j = a.join(b, (F.col("a.trip_id") == F.col("b.trip_id")) & (F.col("a.start") < F.col("b.start")))
    x, y = F.col("a.window"), F.col("b.window")
    return j.select(F.col("a.window_id").alias("a"), F.col("b.window_id").alias("b"), F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 6).alias("jaccard"))


@query("min4_lsh_medoids")
def _(spark, d):
    return lsh.medoids(trips(spark, d), 5, 6, 3, 4, 2).select(KEY(F.col("window")).alias("window"), "mined_support")


# -- corridors ----------------------------------------------------------------


def corridors(spark, d, t: DataFrame | None = None) -> DataFrame:
    """Frequent 3- and 4-grams, and pairs of frequent 2-grams with a hole between. t: the
    trips, where they are written already."""
    t = trips(spark, d) if t is None else t
    one = lambda k, n, m: gate.frequent(t, k, n).select(F.lit(m).alias("method"), F.col("gram").alias("corridor"), F.array(F.split("gram", r"\|")).alias("segments"), F.col("support").alias("mined_support"))
    g = gate.frequent(t, 2, 60)
    # the two sides are the few cells' worth of very frequent transitions
    a, b = g.toDF("ga", "sa"), g.toDF("gb", "sb")
    x, y = F.split("ga", r"\|"), F.split("gb", r"\|")
    holes = a.join(b, F.size(F.array_union(x, y)) == 4).select(F.lit("hole").alias("method"), F.concat("ga", F.lit(" ~ "), "gb").alias("corridor"), F.array(x, y).alias("segments"), F.least("sa", "sb").alias("mined_support"))
    return one(3, 25, "gram3").unionByName(one(4, 12, "gram4")).unionByName(holes)


def measured(spark, d) -> DataFrame:
    c = corridors(spark, d)
    return corridor.metrics(c).join(match.support(trips(spark, d), c.select("corridor", "segments"), P.max_gap, 2), "corridor")


def _valid(spark, d):
    return corridor.valid(measured(spark, d), 3)


@query("jn1_support")
def _(spark, d):
    return match.support(trips(spark, d), corridors(spark, d), P.max_gap, 2)


@query("jn2_spans")
def _(spark, d):
    return match.spans(trips(spark, d), corridors(spark, d), P.max_gap, 2).select("trip_id", "corridor", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


@query("jn3_greedy_spans")
def _(spark, d):
    return match.greedy(trips(spark, d), corridors(spark, d).where("method <> 'gram3'"), P.max_gap)


@query("set4_subset")
def _(spark, d):
    path = io.scratch(spark)
    trips(spark, d).select("trip_id", "cells").write.parquet(path)
    t = spark.read.parquet(path)
    return match.subset(t, corridors(spark, d, t))


@query("min8_verify")
def _(spark, d):
    return match.verify(trips(spark, d), corridors(spark, d), P.max_gap, 2)


@query("min5_longest_repeats")
def _(spark, d):
    return suffix.repeats(trips(spark, d), 5, least=3, gate_k=3)


@query("min6_growth")
def _(spark, d):
    g = growth.grow(trips(spark, d), 8, gate_k=3)
    return g.select("corridor", F.size("segments").alias("n_segments"), "support")


@query("prj18_corridor_metrics")
def _(spark, d):
    m = corridor.metrics(corridors(spark, d))
    return m.select("corridor", *[F.col(c).cast("bigint").alias(c) for c in ("n_cells", "n_segments", "n_holes")], *[F.round(c, 6).alias(c) for c in ("length_km", "covered_km", "end_to_end_km", "tortuosity")], "start_cell", "end_cell")


@query("flt15_valid_corridors")
def _(spark, d):
    return _valid(spark, d).select("corridor")


@query("prj19_records")
def _(spark, d):
    n = trips(spark, d).count()
    return corridor.record(_valid(spark, d), n).select("method", "corridor", "length_km", "support", "support_pct")


@query("win3_ranked")
def _(spark, d):
    return corridor.ranked(_valid(spark, d)).select("corridor", "rank")


@query("win5_capped")
def _(spark, d):
    return corridor.capped(_valid(spark, d), 7).select("method", "corridor")


@query("jn11_contained")
def _(spark, d):
    return corridor.contained(_valid(spark, d))


@query("jn11_without_contained")
def _(spark, d):
    return corridor.without_contained(_valid(spark, d), hole_aware=True).select("corridor", "n_cells")


@query("jn12_overlap_pruned")
def _(spark, d):
    longest = _valid(spark, d).orderBy(F.desc("n_cells"), F.desc("support"), "corridor").select("corridor", "segments", "support")
    # read in order, until enough are kept or the rows end
    rows = (r.asDict() for r in longest.toLocalIterator())
    return spark.createDataFrame([(r["corridor"], r["support"]) for r in corridor.prune_overlapping(rows, 0.5, 100)], "corridor string, support bigint")


@query("agg31_scorecard")
def _(spark, d):
    return corridor.scorecard(_valid(spark, d), KM[1:])


def _thresholds(spark):
    return spark.createDataFrame(list(THRESHOLDS), "pct double, floor int")


@query("agg32_sweep")
def _(spark, d):
    return corridor.sweep(_valid(spark, d), _thresholds(spark), KM[1:])


@query("win9_threshold_choice")
def _(spark, d):
    return corridor.threshold_choice(_valid(spark, d), _thresholds(spark), KM, 20)


@query("agg19_length_ceiling")
def _(spark, d):
    return corridor.length_ceiling(trips(spark, d), KM)


@query("set1_union_methods")
def _(spark, d):
    return corridors(spark, d).groupBy("method").agg(F.count("*").alias("n"))


@query("set3_frequent_difference")
def _(spark, d):
    t = trips(spark, d)
    return gate.frequent(t, 3, 5).select("gram").exceptAll(gate.frequent(t, 3, 10).select("gram"))


@query("set7_child_dedup")
def _(spark, d):
    return measured(spark, d).groupBy("start_cell").agg(F.max("support").alias("support"))


# -- anomalies, time of day, density ------------------------------------------


def _novel(spark, d):
    return analysis.novelty(trips(spark, d), 20).select("trip_id", F.col("n_cells").cast("bigint").alias("n_cells"), "n_rare", "novelty")


@query("min10_novelty")
def _(spark, d):
    return _novel(spark, d)


@query("top3_most_anomalous")
def _(spark, d):
    return analysis.most_anomalous(_novel(spark, d), 20)


@query("agg21_novelty_histogram")
def _(spark, d):
    return analysis.novelty_histogram(_novel(spark, d))


@query("agg22_cell_diversity")
def _(spark, d):
    return analysis.cell_diversity(trips(spark, d), 20)


@query("agg22_cell_diversity_sketched")
def _(spark, d):
    return analysis.cell_diversity(trips(spark, d), 20, b=8)


@query("top4_low_diversity")
def _(spark, d):
    return analysis.cell_diversity(trips(spark, d), 20).orderBy(F.desc("per_taxi"), "cell").limit(10)


@query("min11_temporal_ngrams")
def _(spark, d):
    return analysis.temporal_ngrams(trips(spark, d), (3, 4), 3)


@query("win7_top_by_part")
def _(spark, d):
    return analysis.top_by_part(analysis.temporal_ngrams(trips(spark, d), (3, 4), 3)).select("part", "gram", "rank")


@query("agg24_cell_counts")
def _(spark, d):
    return analysis.cell_counts(trips(spark, d))


@query("top8_busiest_cells")
def _(spark, d):
    return analysis.cell_counts(trips(spark, d)).orderBy(F.desc("visits"), "cell").limit(50)


@query("agg25_smoothed_density")
def _(spark, d):
    return analysis.smoothed(analysis.cell_counts(trips(spark, d)))


@query("prj22_heights")
def _(spark, d):
    return analysis.heights(analysis.cell_counts(trips(spark, d)), 200, 180.0)


@query("jn9_stacked_heights")
def _(spark, d):
    n = analysis.cell_counts(trips(spark, d))
    up = n.select(geo.parent(F.col("cell"), P.edge(9), P.edge(8)).alias("cell"), "visits").groupBy("cell").agg(F.sum("visits").alias("visits"))
    out = analysis.stacked(analysis.heights(n, 200, 180.0), analysis.heights(up, 5, 220.0), P.edge(9), P.edge(8), 40.0)
    return out.select("cell", "height_m", "parent", "base_m")


@query("seq9_elevation")
def _(spark, d):
    return analysis.elevation(trips(spark, d))


@query("min12_ridges")
def _(spark, d):
    rows = analysis.ridges(analysis.elevation(trips(spark, d)))
    return spark.createDataFrame([(i + 1, r["n_cells"], int(r["peak"]), r["avg_elevation"], KEY_OF(r["cells"])) for i, r in enumerate(rows)], "rank int, n_cells int, peak int, avg_elevation double, cells string")


@query("top12_ridges_by_km")
def _(spark, d):
    """Ridges of the walks, by least length."""
    rows = analysis.ridges(analysis.elevation(trips(spark, d)))
    return analysis.ridges_by_length(spark, rows, P.edge(9), (1.0, 3.0, 5.0, 10.0))


@query("top12_ridges_res11")
def _(spark, d):
    """Ridges of the raw traces on resolution 11; none where traces are too few to touch."""
    t = _encoded(spark, d).select(seq.dedup(geo.encode_all(F.col("coordinates"), P.ridge_edge_km, P)).alias("cells"))
    rows = analysis.ridges(analysis.elevation(t))
    return analysis.ridges_by_length(spark, rows, P.ridge_edge_km, (1.0, 3.0, 5.0, 10.0))


@query("seq10_11_extensions")
def _(spark, d):
    """One round of growth from the frequent 3-grams: what each corridor's trips do next."""
    t = trips(spark, d)
    g = gate.frequent(t, 3, 25)
    front = g.select(F.col("gram").alias("corridor"), F.array(F.split("gram", r"\|")).alias("segments"), "support")
    ext = growth.extensions(t, front, match.spans(t, front, P.max_gap, 1), 3, gate.frequent(t, 3, 8), 4, P.max_gap)
    return ext.where("support >= 8").select("corridor", "kind", KEY(F.col("step")).alias("step"), "support", "hop")


@query("win10_branches")
def _(spark, d):
    """The children of that round that are kept: two a parent, valid, of different cells."""
    t = trips(spark, d)
    g = gate.frequent(t, 3, 25)
    front = g.select(F.col("gram").alias("corridor"), F.array(F.split("gram", r"\|")).alias("segments"), "support")
    ext = growth.extensions(t, front, match.spans(t, front, P.max_gap, 1), 3, gate.frequent(t, 3, 8), 4, P.max_gap).where("support >= 8")
    kids = corridor.valid(corridor.metrics(growth.children(front, ext, 2)), 3)
    return growth.branches(kids, 2).select("parent", "corridor", "support")


def KEY_OF(cells: list[str]) -> str:
    return "|".join(cells)


# -- exploratory tables -------------------------------------------------------


def _clock(spark, d):
    return trips(spark, d).select("*", *clean.clock(F.col("start_epoch")))


@query("agg26_by_hour")
def _(spark, d):
    return analysis.value_counts(_clock(spark, d), "hour_of_day", list(range(24)))


@query("agg26_by_day")
def _(spark, d):
    return analysis.value_counts(_clock(spark, d), "day_of_week", list(range(1, 8)))


@query("agg26_sequence_lengths")
def _(spark, d):
    return analysis.value_counts(trips(spark, d).select(F.size("cells").cast("bigint").alias("n")), "n")


@query("prj20_call_types")
def _(spark, d):
    label = F.create_map(*[F.lit(x) for x in ("A", "central", "B", "stand", "C", "street")])[F.col("CALL_TYPE")]
    return clean.clean(raw_trips(spark, d)).groupBy(label.alias("call_type")).agg(F.count("*").alias("n"))


@query("top10_stands")
def _(spark, d):
    c = clean.clean(raw_trips(spark, d)).where("ORIGIN_STAND <> ''")
    return c.groupBy(F.concat(F.lit("Stand #"), "ORIGIN_STAND").alias("stand")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stand").limit(10)


@query("agg27_distance_summary")
def _(spark, d):
    return analysis.describe(trips(spark, d), "distance_km")


@query("agg35_minutes_summary")
def _(spark, d):
    return analysis.describe(trips(spark, d).select((F.col("duration_sec") / 60.0).alias("m")), "m")


@query("agg28_distance_histogram")
def _(spark, d):
    return analysis.histogram(trips(spark, d), "distance_km", KM_EDGES)


@query("agg28_duration_histogram")
def _(spark, d):
    return analysis.histogram(trips(spark, d), "duration_sec", MIN_EDGES)


@query("agg29_speed_by_hour")
def _(spark, d):
    return _clock(spark, d).groupBy(F.col("hour_of_day").cast("bigint").alias("hour")).agg(F.round(F.avg("speed_kmh"), 4).alias("mean_kmh"))


@query("agg30_per_taxi")
def _(spark, d):
    return analysis.per_actor(trips(spark, d))


@query("order_ngrams")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("trip_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("s"))
    return gate.ngram_support(o.select("trip_id", F.col("s.o_orderpriority").alias("cells")), 3)
