from __future__ import annotations

import hashlib
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import pytest

from wayspark.llm import bpe, exact_dedup, fingerprints, html_extract, line_dedup, mixing, pii, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, h1 int, size string, keep_id int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, "y", 2) for i, t, s in rows], SCHEMA)


def words(t):
    return len((t or "").encode().split())


ODD = [(5, None, "a"), (1, "", "a"), (2, " \t\n ", None), (3, "one", None), (4, "x" * 100_000, "b"), (6, "a b  c", "b"), (7, "a\tb c", "b"), (None, "a b c", "c"), (8, "é É ﬁ Ⅳ", "c"), (9, "a b c", "c"), (9, "a b c", "c"), (10, "w " * 30_000, "a")]


def test_exact_dedup(spark):
    rng = random.Random(0)
    rows = ODD + [(100 + i, rng.choice(["p q", "p  q", "r", "", None]), "z") for i in range(60)]
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, (_, t, _) in enumerate(rows)}
    want = []
    for k, (i, _, _) in enumerate(rows):
        same = [rows[j][0] for j in norm if norm[j] == norm[k]]
        keep = min((x for x in same if x is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(norm[k].encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows), salts=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_compares_content(spark, monkeypatch):
    """Texts that share all digests stay apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digests", lambda body: {"text_sha256": F.lit("same"), "h2": F.lit(1).cast("bigint"), "len": F.lit(1)})
    rows = [(i, "ab"[i % 2], "z") for i in range(10)]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect())
    assert got == [(i, i % 2, 5) for i in range(10)]


def mix_brute(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= full
    return size, target


def test_mixing(spark):
    rng = random.Random(1)
    rows = ODD + [(200 + i, " ".join("w1! x y"[: rng.randint(1, 7)] for _ in range(rng.randint(0, 90))), rng.choice(["a", "b", "c", "dd", None])) for i in range(400)]
    size, target = mix_brute(rows)
    got = mixing.mix_sources(frame(spark, rows), buckets=8).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix_sources(frame(spark, rows[::-1]), buckets=64).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)
    # complete epochs come first, then keys in ascending order
    for s in size:
        some = sorted((r for r in got if r["source"] == s and r["size"]), key=lambda r: r["exp_key"])
        times = [r["taken"] / r["size"] for r in some]
        assert times == sorted(times, reverse=True)
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mix_sources(frame(spark, [(1, None, None)])).first()["taken"] == 0


def canon(t):
    f = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", f(f(t).casefold())).strip(" ")


def test_fingerprints(spark):
    rows = [r for r in ODD if r[0] is not None and r[0] != 9] + [(20, "Größe  ﬁn", "a"), (21, "größe FIN", "a"), (24, "Straße ΛΌΓΟΣ", "a"), (25, "STRASSE λόγος", "a"), (22, "café", "a"), (23, "CAFÉ", "a")] + [(30 + i, f"t{i} " * (i % 7 + 1), "a") for i in range(60)]
    rows.sort()
    text = [t or "" for _, t, _ in rows]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame(spark, rows[::-1])).collect()}
    by_canon = {}
    for k, (i, _, _) in enumerate(rows):
        t, nxt = text[k], text[(k + 1) % len(rows)]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canon(t) == canon(edited)) and r["near_next"] == float(canon(t) == canon(nxt))
        assert by_canon.setdefault(canon(t), r["fingerprint"]) == r["fingerprint"]
        assert by_canon.setdefault(canon(edited), r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(by_canon.values())) == len(by_canon)
    assert got[24]["fingerprint"] == got[25]["fingerprint"]
    assert got[20]["fingerprint"] == got[21]["fingerprint"] and got[22]["fingerprint"] == got[23]["fingerprint"]


def test_next_text_over_many_buckets(spark):
    rows = [(i, f"t{i}") for i in random.Random(3).sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = sorted(rows)
    want = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    for per in (1, 7, 10_000):
        assert {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, rows_per_bucket=per).collect()} == want


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_documents(frame(spark, [(1, "abab", "a")])).collect()
    assert [r["near_edited"] for r in one] == [1.0]
    assert fingerprints.fingerprint_documents(frame(spark, [(None, "x", "a"), (None, None, "a"), (1, "y", "a"), (1, "y", "a")])).count() == 4


def test_clashing_digests_get_ordinals(spark):
    df = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("e", "c")], "digest string, canon string")
    assert [tuple(r) for r in fingerprints.clashes(df).collect()] == [("d", "b", 1)]


TEXTS = ["", "  ", "hello world", "a" * 9000, "thethe" * 2000, "é" * 3000 + "x1y22!!", "İstanbul ΣΑΣ Σ", "<|endoftext|>hi <|startoftext|>", "x\x1cy \x85z áb", "don't WE'LL 'd'''" * 60, "日本語" * 900, "!" * 9000, "💩" * 700]


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("leaf", [3, 16, 257])
def test_bpe_tree_is_exact(leaf):
    path = bpe.vocabulary()
    enc, lib, rng = bpe.TreeEncoder(path, leaf=leaf), library(bpe.vocabulary()), random.Random(leaf)
    more = ["".join(rng.choice(a) for _ in range(n)) for a in ("thean ringo", "theanringo", "aab", "ab'!1 é") for n in (40, 700, 5000)]
    for t in TEXTS + more:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids
        assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_joins_halves_of_texts():
    """Cuts fall within runs, between them and in white space; the ids stay the library's."""
    path = bpe.vocabulary()
    rng = random.Random(2)
    for span in (1, 7, 64):
        enc, lib = bpe.TreeEncoder(path, span=span), library(path)
        for t in TEXTS + ["".join(rng.choice("ab e'é1.\n\t\x1c Σß") for _ in range(n)) for n in (2, 9, 80, 900)]:
            assert enc.encode(t) == lib.encode(t, add_special_tokens=False).ids, (span, t[:50])
        assert enc.joins > 20
    # documents of the tables are long enough to be cut
    import duckdb

    enc, lib = bpe.TreeEncoder(path), library(path)
    for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) > 9000").fetchall():
        assert enc.encode(t) == lib.encode(t, add_special_tokens=False).ids
    assert enc.joins > 10


def test_bpe_documents(spark):
    lib = library(bpe.vocabulary())
    rows = [(k, t, "a") for k, t in enumerate(TEXTS)] + ODD
    got = bpe.encode_documents(frame(spark, rows), leaf=64, with_ids=True).collect()
    text = {}
    for i, t, _ in rows:
        text.setdefault(i, set()).add(t)
    assert len(got) == len(rows)
    digests = set()
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        digests.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r)[:4] for r in got} == digests


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies. Really, we do, a lot.</div>
<main><article><h1>Title &amp; more</h1><p>First <b>bold</b> text,
 with   space &lt;here&gt;.<p>Second&nbsp;one, a longer sentence. And more.<ul><li>item one<li>item two</ul><aside>side text.</aside>
<div class="ad">Buy now, cheap, very cheap indeed.</div><form>Name <input></form><section id="comments"><p>Reader says something long, and longer.</p></section></article></main>
<div id="sidebar">Links, many links.</div><footer>&copy; all</footer></body></html>"""


def test_html_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst bold text, with space <here>.\nSecond one, a longer sentence. And more.\nitem one\nitem two"
    plain = "<body><div id=menu>x</div><div class='c1'><p>A long sentence, with commas, and more.</p><p>Another long sentence, here.</p><p>short</p></div><div>zz</div></body>"
    assert html_extract.main_text(plain) == "A long sentence, with commas, and more.\nAnother long sentence, here.\nshort"
    for t in ("", "no tags", "<p", "<<<>>>", "<article>", "a < b", '<p class="x>unclosed', "<!-- never ends", "<script>x", "&amp;lt;" * 3):
        assert isinstance(html_extract.main_text(t), str)
    assert html_extract.main_text("a < b & c") == "a < b & c"


def test_html_scores_choose(monkeypatch):
    # no article element, classes that say nothing
    text = "A sentence of the story, with commas, and a point. " * 4
    page = "<body><div class=q1><ul>" + "<li><a href=x>One link</a>" * 30 + "</ul></div><div class=q2><h2>Title of it</h2>" + f"<p>{text}</p>" * 3 + "</div><div class=q3>Small print</div></body>"
    want = "\n".join(["Title of it", *[text.strip()] * 3])
    assert html_extract.main_text(page) == want
    # a short article beside a longer notice of a name that says so
    short = f"<body><div class=ad>{text}</div><article><h1>Head</h1><p>Short one.</p></article></body>"
    assert html_extract.main_text(short) == "Head\nShort one."
    monkeypatch.setattr(html_extract, "content_nodes", lambda found: [True] * len(found))
    assert html_extract.main_text(page) != want and html_extract.main_text(short) != "Head\nShort one."


def test_content_nodes_by_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        parts = [f"<{(t := rng.choice(['p', 'div', 'li', 'h2']))}>{'word, ' * rng.randint(0, 30)}x{i}</{t}>" for i in range(rng.randint(1, 25))]
        page = f"<body><article>{''.join(parts[:9])}</article><div class=menu>{''.join(parts[9:14])}</div>{''.join(parts[14:])}</body>"
        _, found = html_extract.blocks(page)

        def path(x):
            return path(x.parent) + "/" + x.tag if x.parent else ""

        paths = [path(x) for x, _ in found]
        mean = lambda p, f: sum(f(t) for q, (_, t) in zip(paths, found) if q == p) / paths.count(p)
        near = lambda v, i: sum(v[j] * 0.5 ** abs(i - j) for j in range(len(v)) if abs(i - j) <= 2) / sum(0.5 ** abs(i - j) for j in range(len(v)) if abs(i - j) <= 2)
        size, marks = [mean(p, len) for p in paths], [mean(p, lambda t: t.count(",")) for p in paths]
        names = [0.02 if 9 <= i < 14 else 4 if i < 9 else 1 for i in range(len(found))]
        fused = [near(size, i) * (1 + near(marks, i)) * names[i] for i in range(len(found))]
        bar = min(float(np.std(fused)), max(fused))
        assert [f >= bar - 1e-9 for f in fused] == [y or abs(f - bar) < 1e-9 for y, f in zip(html_extract.content_nodes(found), fused)]


def test_deep_pages_take_linear_time():
    import time

    for opened, closed in (("<div>", "</div>"), ("<td><div><p>", "</b></div>"), ("<span><b>", "</i></span>")):
        start = time.time()
        assert html_extract.main_text(opened * 100_000 + "hello there, you." + closed * 100_000) == "hello there, you."
        assert time.time() - start < 30


def test_html_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, "", "x"), (None, "v", "<p>hi there.</p>" * 2, "x")], "page_id bigint, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()), key=str)
    assert got[1:] == [(2, "", 0), (2, "", 0), (None, "hi there.\nhi there.", 19)] and got[0][2] == len(got[0][1])
    assert html_extract.extract_pages(df.limit(0)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_brute(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice(["1", "2", "55", "4111 1111 1111 1111", ".", ".", "@", "a", "b-c", " ", "+", "(", ")", "-", "é", "x@y.z", "1.2.3.4", "+1 (555) 123-4567"]) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(t) == base_brute(t), t
    assert pii.base_spans("1" * 50_000 + "." + "a@" * 20_000) == []


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"please mail: user{i}@site.org now, words here", "a") for i in range(40)]
    rows += [(100, "please mail: user77@site now, words here", "a"), (101, "please see: user77@site now", "a"), (102, None, "a"), (102, "", "a"), (None, "mail: a1@b.cd", "a")]
    got = pii.extract(frame(spark, rows)).collect()
    spans = {(r["doc_id"], r["n_email"]): r["spans"] for r in got}
    assert len(got) == len(rows) and spans[(0, 1)] == "email:13:27"
    for i, t, _ in rows:
        r = next(r for r in got if r["doc_id"] == i and r["n_email"] == len(base_brute(t or "")))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base_brute(t or ""))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"].startswith(text)
    assert spans[(101, 0)] == "" and pii.extract(frame(spark, [])).count() == 0


def test_pattern_scores(spark):
    # a pattern with mostly seeds, another with few
    edges = [(1, i, "email") for i in range(9)] + [(1, 100, "")] + [(2, i, "") for i in range(100, 110)] + [(2, 0, "email"), (2, 1, "email"), (2, 2, "email")]
    df = spark.createDataFrame(edges, "p bigint, i bigint, k string")
    assert [tuple(r) for r in pii.score_patterns(df, 3, 0.9, 3, 0.5).collect()] == [(1, "email")]


def similar(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
        prev = now
    return 1 - prev[-1] / max(len(a), len(b)) >= 0.8 - 1e-9


def normal(line):
    return re.sub(r"[ \t\r\v\f]+", " ", line).lower().strip(" ")


def lines_brute(docs):
    """Groups from all pairs of distinct lines, by their edit similarity alone."""
    occ = [(d, p, normal(x)) for d, t in docs for p, x in enumerate(t.split("\n")) if normal(x)]
    names = sorted({n for _, _, n in occ})
    up = {n: n for n in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) + 1e-9 and find(a) != find(b) and similar(a, b):
                up[find(a)] = find(b)
    first = {}
    for d, p, n in sorted(occ):
        first.setdefault(find(n), (d, p))
    gone = {(d, p) for d, p, n in occ if first[find(n)] != (d, p)}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in docs}


def test_line_dedup(spark):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(60)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(5, 40))] for _ in range(15)]
    docs = []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] += rng.choice(["x", ".", "!"])
            lines.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        docs.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    want = lines_brute(docs)
    # no line goes that shouldn't; nearly all that should, do
    assert all(set(want[d].split("\n")) <= set(t.split("\n")) | {""} for d, t in got.items())
    assert sum(got[d] == want[d] for d in want) >= 0.97 * len(want)


def test_line_dedup_of_odd_rows(spark):
    long = "this line is long enough to count"
    rows = [(1, None, "a"), (2, "", "a"), (4, f"{long}\nok\n\n{long.upper()}", "a"), (3, f"ok\n {long} ", "a"), (5, f"ok\n{long}", "a"), (5, f"ok\n{long}", "a"), (None, long, "a"), (6, "w " * 50_000, "a"), (7, " ".join(f"w{i % 4000}" for i in range(300_000)), "a")]
    df = frame(spark, rows)
    out = line_dedup.dedup_lines(df)
    assert out.columns[: len(df.columns)] == df.columns
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in out.collect()), key=str)
    want = [(1, None, 0), (2, "", 0), (4, "", 3), (3, f"ok\n {long} ", 0), (5, "", 2), (5, "", 2), (None, "", 1), (6, "w " * 50_000, 0), (7, rows[-1][1], 0)]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def toxic_rows(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["zorgful", "vexnasty", "qqhate" + rng.choice(["er", "ful", "ing"])]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_learns_from_rows_not_held_out(spark):
    rows = toxic_rows(500, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "zorgful " * 20_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    net = toxicity.fit_model(docs, labels, 80, 160)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, net).collect()}
    assert len(got) == 503 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[9000]["score"] == got[9001]["score"] and got[9000]["predicted"] == 0 and got[9002]["predicted"] == 1
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and sum(r["held_out"] for i, r in got.items() if i < 500) == len(held)
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.93
    # labels of held-out rows are not looked at
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id bigint, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, toxicity.fit_model(docs, flipped, 80, 160)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    """The driver holds neither the sample nor the training, only what was learnt."""
    rows = toxic_rows(200, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    with monkeypatch.context() as m:
        m.setattr(toxicity, "_adagrad", None)  # the driver's; tasks import their own
        net = toxicity.fit_model(docs, labels)
    known = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    want = toxicity.train([t for t, _ in known], np.array([y for _, y in known]))
    assert list(net.p) == list(want.p) and all(np.allclose(net.p[k], want.p[k], atol=1e-4) for k in want.p)


def test_windows_overlap_and_cover():
    s = toxicity.Sizes(window=8, stride=4)
    for n in (0, 1, 8, 9, 12, 13, 100):
        st = toxicity.cut(n, s)
        assert set(range(n)) <= {x for a in st for x in range(a, a + 8)} and st[-1] + 8 == max(n, 8)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    net = toxicity.Network(toxicity.Sizes(words=8, grams=8, width=2, hidden=3, window=4)).init(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table = rng.standard_normal((2, 5, 9))
    index, mask = rng.integers(0, 5, (6, 4)), np.ones((6, 4), bool)
    mask[3, 2:] = False
    y = np.array([0.0, 1, 0, 1, 1, 0])
    loss = lambda: net.gradient(table, index, mask, y)[0]
    _, g, dx = net.gradient(table, index, mask, y)
    for k in ("u", "att", "out", "bias"):
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-4
        up = loss()
        net.p[k][at] -= 2e-4
        assert (up - loss()) / 2e-4 == pytest.approx(float(g[k][at]), abs=2e-4)
        net.p[k][at] += 1e-4


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    net = toxicity.fit_model(docs, labels)
    assert [r["predicted"] for r in toxicity.score_documents(docs, net).collect()] == [0, 0]
    assert toxicity.score_documents(docs.limit(0), net).count() == 0
