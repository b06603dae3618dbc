from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from wayspark.llm.jaccard_join import SignatureTree, bitmap, jaccard_components

SCHEMA = "doc_id bigint, text string, lang string, rep bigint, family string"


def brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        k = min(width, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(60)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.2:
            words += common
        rows.append((i * 3, (" " if rng.random() < 0.5 else "\t\n").join(words).upper() if rng.random() < 0.1 else " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "width", "num", "den", "block"), [(1, 3, 9, 10, 1500), (2, 5, 4, 5, 1500), (3, 3, 9, 10, 6), (4, 5, 4, 5, 4), (5, 2, 1, 2, 1500), (6, 3, 3, 5, 1500), (7, 2, 1, 2, 5), (8, 1, 1, 3, 6)])
def test_components_are_those_of_brute_force(spark, seed, width, num, den, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, width=width, num=num, den=den, block_rows=block, hubs=2).collect()}
    assert got == brute(rows, width, num, den)


def test_node_pairs_are_dropped():
    """The traversal drops pairs of nodes, and loses no link, by sets or by bitmaps."""
    rng = random.Random(4)
    sets = []
    for _ in range(25):
        base = [rng.randrange(1 << 62) for _ in range(120)]
        for _ in range(6):
            s = list(base)
            for _ in range(rng.randint(0, 14)):
                s[rng.randrange(120)] = rng.randrange(1 << 62)
            sets.append(np.unique(np.array(s, np.uint64)))
    rng.shuffle(sets)
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}

    def classes(pairs):
        up = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    tree = SignatureTree(sets, 4, 5)
    assert classes(tree.join()) == classes(want) and tree.dropped > 100
    marks = SignatureTree(None, 4, 5, bitmaps=np.stack([bitmap(s, 256) for s in sets]), sizes=np.array([len(s) for s in sets]))
    open_pairs = {(min(p), max(p)) for p in marks.join()}
    assert want <= open_pairs and len(open_pairs) < 2 * len(want) + 50 and marks.dropped > 100
    sides = np.array([i % 2 for i in range(len(sets))])
    two = SignatureTree(None, 4, 5, bitmaps=marks.bitmaps, sizes=marks.sizes, sides=sides)
    assert {(min(p), max(p)) for p in two.join()} == {(i, j) for i, j in open_pairs if sides[i] != sides[j]}


def test_similarity_is_checked(spark):
    for num, den in ((0, 1), (3, 2)):
        with pytest.raises(ValueError):
            jaccard_components(spark.createDataFrame([], SCHEMA), num=num, den=den)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a"), (None, "a b"), (7, "x " * 5000), (8, "X " * 6000), (9, "a b c")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, width=3, num=9, den=10).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, None), (7, 1, 7), (8, 1, 7), (9, 1, 9)]
    assert got == sorted(want, key=str)


def test_empty_and_repeated(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", None, None, None)] * 3 + [(0, "a b c d e f", None, None, None)], SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(df).collect()) == [(0, 0), (1, 0), (1, 0), (1, 0)]
