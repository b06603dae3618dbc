from __future__ import annotations

import random

import duckdb
import pytest

import corpus_pipeline as cp
from wayspark.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(0)
    for n, m in ((1, 0), (40, 25), (300, 500), (500, 300)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1000 + n)]
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
        df = spark.createDataFrame(edges, "a bigint, b bigint")
        assert {r.id: r.root for r in common.components(df).collect()} == want
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stages_in_order():
    assert [k for k, _ in cp.STAGES] == ["toxicity", "line dedup", "near copies", "mixing", "BPE"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_line_stage_drops_bare_documents_only(spark):
    a, b = "the first line is here today", "another line that is long enough"
    rows = [(1, f"{a}\n{b}", "s"), (2, a, "s"), (3, f"{a}\nnew and different words follow now", "s"), (4, "", "s"), (5, None, "s")]
    out = cp.drop_repeated_lines(spark, docs(spark, rows), SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (f"{a}\n{b}", len(a) + len(b) + 1), 3: ("new and different words follow now", 34), 4: ("", 0), 5: (None, None)}


def test_near_copy_stage_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(500)}" for _ in range(200)] for _ in range(6)]
    rows = []
    for i in range(40):
        w = list(base[i % 6])
        w[rng.randrange(200)] = "changed"
        rows.append((i, " ".join(w), "s"))
    out = cp.one_of_near_copies(spark, docs(spark, rows + [(100, None, None), (101, "", None)]), SF)
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 4, 5, 100, 101]


def test_mix_stage_repeats_documents(spark):
    rows = [(i, f"w{i} " * (10 + i % 5), "abc"[i % 3]) for i in range(90)]
    out = cp.mix(spark, docs(spark, rows), SF).collect()
    by = {}
    for r in out:
        by[r.doc_id] = by.get(r.doc_id, 0) + 1
    text = {i: t for i, t, _ in rows}
    assert max(by.values()) <= 2 and all(r.text == text[r.doc_id] for r in out)
    size = lambda s: sum(len(t.split()) for _, t, x in rows if x == s)
    assert sum(len(r.text.split()) for r in out if r.source == "a") == pytest.approx(2 * size("a"), abs=15)


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 50 < out.count() < 400


def test_stages_take_empty_tables(spark):
    at = docs(spark, [])
    for _, f in cp.STAGES:
        out = f(spark, at, SF)
        assert out.count() == 0
        at = spark.createDataFrame([], out.schema)


TABLES = "documents pages labels benchmark embeddings conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    df = queries.QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = df.collect()
    table = "pages" if "page_id" in df.columns else "documents"
    assert len(rows) == c.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name in queries.ORACLE_SQL:
        res = c.sql(queries.ORACLE_SQL[name])
        plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        cols = res.columns
        assert sorted(cols) == sorted(df.columns)
        assert sorted(tuple(plain(r[k]) for k in cols) for r in rows) == sorted(tuple(map(plain, r)) for r in res.fetchall())
