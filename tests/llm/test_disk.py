"""What line dedup and the Jaccard join leave on disk, and the pairs that they write."""

from __future__ import annotations

import os

from wayspark.llm import jaccard_join, line_dedup
from wayspark.llm.common import recorded


def _left(spark, paths):
    """The columns of the folders that are still there."""
    return [set(spark.read.parquet(p).columns) for p in paths if os.path.exists(p.removeprefix("file://"))]


def _docs(spark):
    text = "\n".join(f"the {i} quick brown foxes jump over the {i * 7} lazy dogs of house number {i}" for i in range(20))
    return spark.createDataFrame([(i, text + f"\nlast line of the text {i}") for i in range(12)], "doc_id bigint, text string")


def test_line_dedup_leaves_only_what_its_result_reads(spark):
    with recorded() as paths:
        out = line_dedup.dedup_lines(_docs(spark))
    left = _left(spark, paths)
    assert not any({"norm", "w0", "open"} & columns for columns in left) and len(left) == 3, left
    assert out.count() == 12 and out.where("n_dropped >= 20").count() == 11


def test_jaccard_join_drops_digests_and_moves_no_set_to_find_hubs(spark):
    with recorded() as paths:
        out = jaccard_join.jaccard_components(_docs(spark), block_rows=4, hubs=2)
    assert not any("sigs" in columns for columns in _left(spark, paths))
    assert [r["component_id"] for r in out.orderBy("doc_id").collect()] == [0] * 12


def test_lines_of_one_component_are_not_paired_again(spark):
    norm = [f"a line of some ten words that differ here in {x}" for x in ("one", "two", "three", "four", "five")]
    looks = line_dedup._looks(spark.createDataFrame(list(enumerate(norm)), "lid bigint, norm string"))
    members = spark.createDataFrame([(7, 5, 10, 10, i, 0, False) for i in range(1, 5)], "key bigint, size bigint, low int, high int, lid bigint, hub bigint, open boolean")
    # 1 is with the hub, 2 with 3 by another key
    near = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "id bigint, root bigint")
    pairs = {(r["a"], r["b"]) for r in line_dedup._further(members, looks, near, 0.8).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)}, pairs
