from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wayspark.config import DEFAULT as P
from wayspark.functions import geo, seq


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_haversine_is_the_great_circle(spark):
    r = one(spark, geo.haversine(F.lit(-8.6), F.lit(41.1), F.lit(-8.5), F.lit(41.2)).alias("d"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("half"))
    a = math.sin(math.radians(0.1) / 2) ** 2 + math.cos(math.radians(41.1)) * math.cos(math.radians(41.2)) * math.sin(math.radians(0.1) / 2) ** 2
    assert r.d == pytest.approx(2 * 6371 * math.asin(math.sqrt(a))) and r.half == pytest.approx(math.pi * 6371)


def test_cells_hold_their_centres_and_have_six_neighbours(spark):
    cells = [(f"{q},{r}",) for q in range(-6, 7) for r in range(-6, 7)]
    df = spark.createDataFrame(cells, "cell string")
    for _, edge in P.edge_km:
        c = geo.centre(F.col("cell"), edge)
        assert df.where(geo.encode(c["lng"], c["lat"], edge) != F.col("cell")).count() == 0
    rows = df.select("cell", geo.ring(F.col("cell")).alias("ring")).collect()
    for r in rows:
        assert len(set(r.ring)) == 6 and r.cell not in r.ring
    near = df.select("cell", F.explode(geo.ring(F.col("cell"))).alias("other")).withColumn("d", geo.grid_distance(F.col("cell"), F.col("other")))
    assert near.where("d <> 1").count() == 0


def test_points_fall_in_the_nearest_cell(spark):
    rng = random.Random(1)
    pts = [(P.origin_lng + rng.uniform(-0.02, 0.02), P.origin_lat + rng.uniform(-0.02, 0.02)) for _ in range(200)]
    edge = P.edge(9)
    rows = spark.createDataFrame(pts, "lng double, lat double").withColumn("cell", geo.encode(F.col("lng"), F.col("lat"), edge)).collect()
    xy = lambda lng, lat: ((lng - P.origin_lng) * P.km_per_lng, (lat - P.origin_lat) * P.km_per_lat)
    for r in rows:
        q, s = map(int, r.cell.split(","))
        at = lambda q, s: (edge * geo.SQRT3 * (q + s / 2), edge * 1.5 * s)
        own = math.dist(xy(r.lng, r.lat), at(q, s))
        assert own <= edge + 1e-9 and all(own <= math.dist(xy(r.lng, r.lat), at(q + a, s + b)) + 1e-9 for a, b in geo.RING)


def test_grid_path_is_connected(spark):
    rng = random.Random(2)
    pairs = [(f"{rng.randint(-9, 9)},{rng.randint(-9, 9)}", f"{rng.randint(-9, 9)},{rng.randint(-9, 9)}") for _ in range(80)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", geo.grid_distance(F.col("a"), F.col("b")).alias("n"), geo.grid_path(F.col("a"), F.col("b")).alias("path"), geo.bridge(F.col("a"), F.col("b")).alias("bridge")).collect():
        assert len(r.path) == r.n + 1 and r.path[0] == r.a and r.path[-1] == r.b and len(set(r.path)) == len(r.path)
        for x, y in zip(r.path, r.path[1:]):
            (q1, r1), (q2, r2) = (tuple(map(int, c.split(","))) for c in (x, y))
            assert (q2 - q1, r2 - r1) in geo.RING
        assert r.bridge == (None if r.n > 4 else r.path[1:-1])


def test_sequences(spark):
    df = spark.createDataFrame([(1, list("aabbbac")), (2, []), (3, ["x"]), (4, None)], "id int, a array<string>")
    got = {r.id: r for r in df.select("id", seq.dedup(F.col("a")).alias("d"), seq.ngrams(F.col("a"), 3).alias("g"), seq.windows(F.col("a"), 3, 2).alias("w"), seq.suffixes(F.col("a"), 5, 6).alias("s"), seq.transitions(F.col("a")).alias("t")).collect()}
    assert got[1].d == list("abac") and got[2].d == [] and got[3].d == ["x"] and got[4].d is None
    assert ["".join(x) for x in got[1].g] == ["aab", "abb", "bbb", "bba", "bac"] and got[2].g == [] and got[3].g == []
    assert ["".join(x) for x in got[1].w] == ["aab", "bbb", "bac"]
    assert ["".join(x) for x in got[1].s] == ["aabbba", "abbbac", "bbbac"]
    assert ["".join(x) for x in got[1].t] == ["aa", "ab", "bb", "bb", "ba", "ac"]
    at = df.where("id = 1").select(seq.first_at(F.col("a"), F.array(F.lit("b"), F.lit("a")), F.lit(1)).alias("x"), seq.first_at(F.col("a"), F.array(F.lit("a")), F.lit(3)).alias("y"), seq.first_at(F.col("a"), F.array(F.lit("z")), F.lit(1)).alias("z")).first()
    assert (at.x, at.y, at.z) == (5, 6, None)
