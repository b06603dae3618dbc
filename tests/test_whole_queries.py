"""Queries run their operators over all of their rows, at the operators' own widths."""

from __future__ import annotations

from wayspark.operators import growth
from wayspark.plans import queries as core

SF = "/root/testdata/sf0.001"


def test_growth_is_registered_at_its_full_width(spark, monkeypatch):
    import inspect

    seen = {}
    whole = inspect.signature(growth.grow)

    def spy(*args, **more):
        bound = whole.bind(*args, **more)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return args[0].sparkSession.createDataFrame([], "corridor string, segments array<array<string>>, support bigint")

    monkeypatch.setattr(growth, "grow", spy)
    core.QUERIES["min6_growth"](spark, SF)
    assert (seen["seeds"], seen["beam"], seen["rounds"]) == (600, 600, 45)


def test_distinct_counter_gives_every_cell(spark, monkeypatch):
    rows = [("few", f"t{i}") for i in range(50)] * 2 + [("many", f"t{i}") for i in range(3000)]
    monkeypatch.setattr(core, "_taxi_cells", lambda *_: spark.createDataFrame(rows, "cell string, taxi string"))
    got = {r["cell"]: r["n_distinct"] for r in core.QUERIES["agg12_distinct_counter_all_cells"](spark, SF).collect()}
    m = 1 << core.HB
    assert got["few"] == 50 and abs(got["many"] / 3000 - 1) < 4 * 1.04 / m**0.5 and set(got) == {"few", "many"}


def test_overlap_pruning_reads_past_many_overlapping_rows(spark, monkeypatch):
    stretch = [f"c{i}" for i in range(20)]
    rows = [(f"a{i:03}", [stretch], 20, 9) for i in range(700)] + [(f"b{i:03}", [[f"d{i}x", f"d{i}y"]], 2, 5) for i in range(120)]
    monkeypatch.setattr(core, "_valid", lambda *_: spark.createDataFrame(rows, "corridor string, segments array<array<string>>, n_cells int, support bigint"))
    got = [r["corridor"] for r in core.QUERIES["jn12_overlap_pruned"](spark, SF).collect()]
    assert got == ["a000"] + [f"b{i:03}" for i in range(99)]
