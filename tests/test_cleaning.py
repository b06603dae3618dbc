from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.operators import clean, encode
from wayspark.plans.fixtures import RULES_SQL, raw_trips
from wayspark.sources import io
from wayspark.streaming import trips as stream

WANT = {
    "T01": "missing_data", "T02": "empty_polyline", "T03": "bad_json", "T04": "too_few_points", "T05": "too_long", "T06": "out_of_bbox", "T07": "gps_jump", "T08": "stationary",
    "T09": "too_short_distance", "T10": "too_long_distance", "T11": "kept", "T12": "kept", "T13": "missing_data", "T14": "empty_polyline", "T15": "empty_polyline",
}


def raw(spark):
    return spark.sql(RULES_SQL).select("TRIP_ID", *[F.lit(None).cast("string").alias(c) for c in ("CALL_TYPE", "ORIGIN_CALL", "ORIGIN_STAND")], F.lit(None).cast("int").alias("TAXI_ID"), F.lit(3600).cast("bigint").alias("TIMESTAMP"), F.lit("A").alias("DAY_TYPE"), "MISSING_DATA", "POLYLINE")


def test_each_rule_has_its_verdict(spark):
    assert {r.TRIP_ID: r.verdict for r in clean.judged(raw(spark)).collect()} == WANT


def test_odd_tracks_do_not_fail(spark):
    lines = ["null", "[null]", "[[]]", "[[1]]", "{}", "[[1,2],null]", "x", '["a","b"]']
    df = spark.createDataFrame([(str(i), "False", x) for i, x in enumerate(lines)], "TRIP_ID string, MISSING_DATA string, POLYLINE string")
    got = clean.judged(df).collect()
    assert len(got) == len(lines) and all(r.verdict in ("bad_json", "too_few_points", "out_of_bbox", "empty_polyline") for r in got)


def test_features_and_counts(spark):
    got = {r.TRIP_ID: r for r in clean.clean(raw(spark)).collect()}
    assert set(got) == {"T11", "T12"}
    t = got["T12"]
    assert (t.num_points, t.num_points_raw, t.duration_sec, t.TAXI_ID, t.CALL_TYPE, t.hour_of_day, t.day_of_week) == (4, 6, 75, 0, "", 1, 5)
    counts = clean.verdict_counts(raw(spark)).collect()
    assert sum(r.trips for r in counts) == len(WANT) and abs(sum(r.pct for r in counts) - 100) < 0.01
    report = clean.report(raw(spark))
    assert report["raw_trips"] == 15 and report["clean_trips"] == 2 and report["rules"]["gps_jump"] == 1


def test_encoding_keeps_order_and_drops_repeats(spark):
    for r in encode.encode(clean.clean(raw(spark))).collect():
        for res in (8, 9, 10):
            cells = r[f"cells_res{res}"]
            assert cells and all(a != b for a, b in zip(cells, cells[1:])) and r[f"start_res{res}"] == cells[0] and r[f"end_res{res}"] == cells[-1] and r[f"len_res{res}"] == len(cells)


def test_csv_with_quoted_tracks(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    raw(spark).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    back = io.read_csv(spark, path)
    got = {r.TRIP_ID: r.verdict for r in clean.judged(back).collect()}
    assert got == WANT


def test_text_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/a/report.json"
    io.write_json(spark, path, {"n": 1, "é": [1, 2]})
    assert io.read_json(spark, path).first().n == 1 and '"n": 1' in io.read_text(spark, path)
    assert io.join_path("gs://b/", "/x", "y/") == "gs://b/x/y" and io.provenance(spark, x=1)["x"] == 1


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    raw_trips(spark, "/root/testdata/sf0.001").repartition(3).write.parquet(src)
    q = stream.write(stream.encoded_stream(stream.raw_stream(spark, src)).drop("coordinates"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert q.awaitTermination(120)
    want = encode.encode(clean.clean(spark.read.parquet(src))).select("TRIP_ID", "cells_res9").collect()
    got = spark.read.parquet(f"file://{tmp_path}/out").select("TRIP_ID", "cells_res9").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and want
    busy = stream.busy_cells(stream.encoded_stream(stream.raw_stream(spark, src)))
    q = busy.writeStream.format("memory").queryName("busy").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("busy").agg(F.sum("visits")).first()[0] == sum(len(r.cells_res9) for r in want)
