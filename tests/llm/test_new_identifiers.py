"""Identifiers of forms that no base pattern has, found by where they stand."""

from __future__ import annotations

from wayspark.llm import pii


def test_new_forms_in_known_contexts(spark):
    new, far = "555-123-4567", "77/4711/99"
    texts = [f"x{i}w phone: +1 555 010 {1000 + i} y{i}w z{i}w" for i in range(40)]
    texts += [f"u{i}w mail: user{i}@site.org v{i}w q{i}w" for i in range(40)]
    texts += [f"please phone: {new} or write", "note mail: user77@site for this", f"on page 1234-{5} it says"]
    # what was found beside 'phone:' makes 'reach-me' a pattern, which has no base seed
    accepted = ["555-200-0001", "555-200-0002", "555-200-0003"]
    texts += [f"k{i}w phone: {x} m{i}w" for i, x in enumerate(accepted)]
    texts += [f"g{j}w reach-me {x} h{j}w" for j, x in enumerate([*accepted] + ["(skip)"])]
    texts += [f"here reach-me {far} there"]
    # enough of the pattern is held
    more = [f"555-300-{1000 + i}" for i in range(9)]
    texts += [f"+1 555 777 {2000 + i} phone: +1 555 888 {3000 + i}" for i in range(120)]
    texts += [t for x in more for t in (f"phone: {x} t{x[-1]}w", f"reach-me {x} s{x[-1]}w")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {texts[r["doc_id"]]: r["spans"] for r in pii.extract(docs).collect()}

    def span(text, kind, token):
        a = text.index(token)
        return f"x_{kind}:{a}:{a + len(token)}"

    one, two = f"please phone: {new} or write", "note mail: user77@site for this"
    assert got[one] == span(one, "phone", new) and got[two] == span(two, "email", "user77@site")
    assert got["on page 1234-5 it says"] == ""
    three = f"here reach-me {far} there"
    assert got[three] == span(three, "phone", far)


def plain_scores(edges, rounds, confidence, seeds, damping):
    """The patterns and kinds that plain loops over the graph give."""
    kind = {}
    for p, i, k in edges:
        kind[p, i] = max(kind.get((p, i), ""), k)
    pats = {}
    for p, i in kind:
        pats.setdefault(p, set()).add(i)
    pats = {p: s for p, s in pats.items() if len(s) >= seeds}
    nodes = {i for s in pats.values() for i in s}
    base = {i: max(k for (p, j), k in kind.items() if j == i and p in pats) for i in nodes}
    held = {i: base[i] or None for i in nodes}
    score = {i: 1.0 if held[i] else 0.0 for i in nodes}

    def judged():
        out = {}
        for p, s in pats.items():
            c = sum(score[i] for i in s) / len(s)
            with_kind = [held[i] for i in s if held[i]]
            best = max(((with_kind.count(k), k) for k in set(with_kind)), default=None)
            out[p] = (c, best[1] if best and len(with_kind) >= seeds and c >= confidence - 1e-12 else None)
        return out

    before = None
    for _ in range(rounds):
        n = sum(h is not None for h in held.values()), round(sum(score.values()), 6)
        if n == before:
            break
        before = n
        now = judged()
        new_held, new_score = {}, {}
        for i in nodes:
            mine = [now[p] for p, s in pats.items() if i in s]
            sure = max(((c, k) for c, k in mine if k), default=None)
            new_held[i] = base[i] or (sure[1] if sure else None)
            new_score[i] = 1.0 if base[i] else sure[0] if sure else max(c * damping for c, _ in mine)
        held, score = new_held, new_score
    return {(p, k) for p, (_, k) in judged().items() if k}


def test_scores_are_those_of_plain_loops(spark):
    """Random graphs, and a chain in which each pattern is found by what the one before
    it held: the last has no base seed, and needs as many turns."""
    import random

    rng = random.Random(6)
    graphs = []
    for _ in range(4):
        graphs.append([(p, i, rng.choice(["email", "phone"]) if i % 3 else "") for p in range(12) for i in rng.sample(range(60), rng.randint(2, 15))])
    chain = [(0, i, "email") for i in range(40)] + [(0, 100 + i, "") for i in range(4)]
    for step in range(1, 6):
        chain += [(step, 100 * step + i, "") for i in range(4)] + [(step, 100 * (step + 1), "")] * (step < 0)
        chain += [(step + 10, 100 * step + i, "") for i in range(4)] + [(step + 10, 40_000 + 100 * step + i, "") for i in range(0)]
    graphs.append(chain)
    for edges in graphs:
        # one kind an instance, as a token has
        kind = {}
        edges = [(p, i, kind.setdefault(i, k)) for p, i, k in edges]
        df = spark.createDataFrame(edges, "p bigint, i bigint, k string")
        got = {tuple(r) for r in pii.score_patterns(df, 20, 0.9, 3, 0.5).collect()}
        assert got == plain_scores(edges, 20, 0.9, 3, 0.5)
    assert (0, "email") in got and (11, "email") in got
