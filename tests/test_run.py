from __future__ import annotations

import json

from wayspark.plans import run, synthetic
from wayspark.plans.fixtures import raw_trips
from wayspark.sources import io

SF = "/root/testdata/sf0.001"


def test_from_raw_trips_to_reports(spark, tmp_path):
    out = f"file://{tmp_path}"
    report = run.stage1(spark, raw_trips(spark, SF), out)
    assert report["clean_trips"] > 0 and report["rules"]["too_long"] == 1
    report = run.stage2(spark, spark.read.parquet(f"{out}/clean"), out)
    assert report["unique_cells_res10"] >= report["unique_cells_res9"] >= report["unique_cells_res8"] > 0
    assert json.loads(io.read_text(spark, f"{out}/encoding_report.json"))["trips"] == report["trips"]
    assert isinstance(run.temporal(spark, spark.read.parquet(f"{out}/encoded"), out, 2), list)


def test_planted_corridors_come_back(spark, tmp_path):
    out = f"file://{tmp_path}"
    trips = synthetic.trips(spark, 300)
    bench = run.stage3(spark, trips, out, x=5.0, sweep=(5.0, 10.0), km=(1.0, 3.0), want=20, beam=20, rounds=10, least=6, max_suffix=40)
    assert {r["method"] for r in bench["scorecard"]} == {"lsh", "suffix", "growth"}
    assert all(r["overstated_pct"] == 0 for r in bench["scorecard"] if r["method"] == "suffix")
    found = spark.read.parquet(f"{out}/corridors").collect()
    whole = {"|".join(f"{q},{r}" for q, r in v) for vs in synthetic.network().values() for v in vs}
    paths = {"|".join(r.cell_sequence) for r in found}
    inside = sum(any(p in w for w in whole) and p.count("|") >= 14 for p in paths)
    assert inside >= 3
    assert any(r.n_holes for r in found if r.method == "growth")
    assert all(r.support >= bench["min_support"] for r in found)
    payload = json.loads(io.read_text(spark, f"{out}/subroutes.json"))
    assert payload["corridors"][0]["n_cells"] == max(r.n_cells for r in found)
    assert json.loads(io.read_text(spark, f"{out}/anomalous_routes.json"))["scored"] > 0
    assert run.ridges(spark, trips, out, min_cells=5)
