"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

_WORDS = re.compile(r"[^\W_]+").findall
_GRAMS = (3, 4, 5)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Sizes:
    """word and char rows of the hashed tables, their width, hidden units, window."""

    words: int = 1 << 15
    grams: int = 1 << 15
    width: int = 8
    hidden: int = 8
    window: int = 32
    stride: int = 16


def tokens(text: str) -> list[str]:
    return _WORDS(text.lower())


def word_rows(words: list[str], sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, rows of its character n-grams one word after another, their
    number for each word). N-grams include marks at both ends of a word."""
    import xxhash

    rows = np.fromiter((xxhash.xxh3_64_intdigest(w) % sizes.words for w in words), np.int64, len(words))
    text = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    found, own = [], []
    for n in _GRAMS:
        k = len(codes) - n + 1
        if k <= 0:
            continue
        same = owner[:k] == owner[n - 1 :]
        h = np.full(k, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : i + k]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        found.append((h[same] % np.uint64(sizes.grams)).astype(np.int64))
        own.append(owner[:k][same])
    grams, own = np.concatenate(found), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return rows, grams[order], np.bincount(own, minlength=len(words))


@dataclass
class Network:
    sizes: Sizes = field(default_factory=Sizes)
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def init(self, rng: np.random.Generator) -> Network:
        s, f = self.sizes, np.float32
        d, h = 2 * s.width, s.hidden
        self.p = {
            "word": (rng.standard_normal((s.words, s.width)) * 0.05).astype(f),
            "gram": (rng.standard_normal((s.grams, s.width)) * 0.15).astype(f),
            "w": (rng.standard_normal((2, d, 3 * h)) * 0.5 / d**0.5).astype(f),
            "u": (rng.standard_normal((2, h, 3 * h)) * 0.5 / h**0.5).astype(f),
            "b": np.zeros((2, 1, 3 * h), f),
            "att": (rng.standard_normal((2 * h,)) * 0.3).astype(f),
            "out": (rng.standard_normal((2 * h,)) * 0.3).astype(f),
            "bias": np.zeros(1, f),
            "platt": np.array([0.5, 0.0], f),
        }
        return self

    def embed(self, rows: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Word and mean character vectors side by side."""
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sums = np.add.reduceat(self.p["gram"][grams], starts, axis=0) if len(grams) else np.zeros((len(rows), self.sizes.width), np.float32)
        return np.concatenate([self.p["word"][rows], sums / counts[:, None].astype(np.float32)], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input share of the gates, (2, words, 3 hidden)."""
        return np.matmul(x[None], self.p["w"]) + self.p["b"]

    def windows(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows (n, window) of rows of the gate table. Both directions
        step together; masked steps leave the state as it is."""
        p, hid = self.p, self.sizes.hidden
        n, steps = index.shape
        h = np.zeros((2, n, hid), np.float32)
        hs = np.empty((steps, 2, n, hid), np.float32)
        kept = []
        full = bool(mask.all())
        for t in range(steps):
            back = steps - 1 - t
            x = np.stack([table[0][index[:, t]], table[1][index[:, back]]])
            a = np.matmul(h, p["u"])
            rz = np.tanh((x[..., : 2 * hid] + a[..., : 2 * hid]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            r, z = rz[..., :hid], rz[..., hid:]
            c = np.tanh(x[..., 2 * hid :] + r * a[..., 2 * hid :])
            new = c + z * (h - c)
            if not full:
                m = np.stack([mask[:, t], mask[:, back]])[..., None]
                new = np.where(m, new, h)
            if keep:
                kept.append((h, a, r, z, c))
            h = new
            hs[t, 0] = h[0]
            hs[back, 1] = h[1]
        score = hs[:, 0] @ p["att"][:hid] + hs[:, 1] @ p["att"][hid:]
        if not full:
            score = np.where(mask.T, score, np.float32(-1e9))
        score -= score.max(0)
        alpha = np.exp(score)
        alpha /= alpha.sum(0)
        pooled = np.concatenate([np.einsum("tn,tnh->nh", alpha, hs[:, 0]), np.einsum("tn,tnh->nh", alpha, hs[:, 1])], axis=1)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (hs, kept, alpha, pooled)) if keep else logit

    def gradient(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the dense parameters, and of the gate table's rows in
        index, (2, n, window, 3 hidden)."""
        p, hid = self.p, self.sizes.hidden
        logit, (hs, kept, alpha, pooled) = self.windows(table, index, mask, keep=True)
        n, steps = index.shape
        prob = 1 / (1 + np.exp(-logit))
        loss = float(-(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)).mean())
        d = ((prob - y) / n).astype(np.float32)
        g = {"bias": np.array([d.sum()], np.float32), "out": pooled.T @ d}
        dp = d[:, None] * p["out"][None]
        both = np.concatenate([hs[:, 0], hs[:, 1]], axis=2)
        da = np.einsum("tnh,nh->tn", both, dp)
        ds = alpha * (da - (alpha * da).sum(0))
        g["att"] = np.einsum("tn,tnh->h", ds, both)
        dboth = alpha[..., None] * dp[None] + ds[..., None] * p["att"]
        dx = np.zeros((2, n, steps, 3 * hid), np.float32)
        g["u"] = np.zeros_like(p["u"])
        dh = np.zeros((2, n, hid), np.float32)
        ut = p["u"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            dh = dh + np.stack([dboth[t, :, :hid], dboth[back, :, hid:]])
            m = np.stack([mask[:, t], mask[:, back]])[..., None]
            h, a, r, z, c = kept[t]
            dnew = np.where(m, dh, 0)
            dz = dnew * (h - c) * z * (1 - z)
            dc = dnew * (1 - z) * (1 - c * c)
            dr = dc * a[..., 2 * hid :] * r * (1 - r)
            dxt = np.concatenate([dr, dz, dc], axis=2)
            dat = np.concatenate([dr, dz, dc * r], axis=2)
            g["u"] += np.matmul(h.transpose(0, 2, 1), dat)
            dh = np.where(m, dnew * z, dh) + np.matmul(dat, ut)
            dx[0, :, t], dx[1, :, back] = dxt[0], dxt[1]
        return loss, g, dx


def cut(n: int, sizes: Sizes) -> list[int]:
    """Starts of the overlapping windows over n words; the last ends at the end."""
    if n <= sizes.window:
        return [0]
    starts = list(range(0, n - sizes.window, sizes.stride))
    return [*starts, n - sizes.window]


class Scorer:
    """Scores whole texts; keeps the gate rows of words in a table of bounded size."""

    def __init__(self, net: Network, most: int = 60_000) -> None:
        self.net, self.most = net, most
        self.reset()

    def reset(self) -> None:
        h = 3 * self.net.sizes.hidden
        self.ids: dict[str, int] = {}
        self.table = np.zeros((2, 1 << 12, h), np.float32)

    def learn(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = set()
        for d in docs:
            new.update(d)
        if len(self.ids) + len(new) > self.most:
            self.reset()
        add = [w for w in new if w not in self.ids]
        for lo in range(0, len(add), 20_000):
            part = add[lo : lo + 20_000]
            n = len(self.ids) + 1
            while n + len(part) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            rows = word_rows(part, self.net.sizes)
            self.table[:, n : n + len(part)] = self.net.gates(self.net.embed(*rows))
            self.ids.update(zip(part, range(n, n + len(part))))
        get = self.ids.__getitem__
        return [np.fromiter(map(get, d), np.int32, len(d)) for d in docs]

    def window_logits(self, docs: list[list[str]], block: int = 1024) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        s = self.net.sizes
        ids = self.learn(docs)
        starts = [np.array(cut(len(d), s)) for d in ids]
        index = np.zeros((sum(map(len, starts)), s.window), np.int32)
        mask = np.ones(index.shape, bool)
        at = 0
        steps = np.arange(s.window)
        for d, st in zip(ids, starts):
            if len(d) >= s.window:
                index[at : at + len(st)] = d[st[:, None] + steps]
            else:
                index[at, : len(d)] = d
                mask[at, len(d) :] = False
            at += len(st)
        out = np.empty(len(index), np.float32)
        whole = mask.all(1)
        for which in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for lo in range(0, len(which), block):
                w = which[lo : lo + block]
                out[w] = self.net.windows(self.table, index[w], mask[w])
        return np.split(out, np.cumsum([len(x) for x in starts])[:-1]) if starts else []

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities: the logit of the highest window, calibrated."""
        docs = [tokens(t) for t in texts]
        if not docs:
            return np.zeros(0)
        logits = self.window_logits(docs)
        a, c = self.net.p["platt"]
        z = np.array([a * x.max() + c for x in logits], np.float64)
        return 1 / (1 + np.exp(-z))


def _adagrad(value: np.ndarray, state: np.ndarray, grad: np.ndarray, lr: float) -> None:
    state += grad * grad
    value -= lr * grad / np.sqrt(state + 1e-8)


def train(texts: list[str], labels: np.ndarray, sizes: Sizes | None = None, rounds: int = 3, epochs: int = 3, least_steps: int = 200, seed: int = 5) -> Network:
    """Train on whole texts. Only texts are labelled, so that windows are chosen: at
    first those whose words speak most for the label by their counts, then, in each
    round, those that the network itself scores highest, in texts of either label,
    beside others at random from clean texts. A round has at least least_steps steps. A
    fifth of the texts is left for the calibration of the highest window's logit."""
    sizes = sizes or Sizes()
    rng = np.random.default_rng(seed)
    net = Network(sizes).init(rng)
    # one object for each distinct word, as the texts' words are held throughout
    same: dict[str, str] = {}
    docs = [[same.setdefault(w, w) for w in tokens(t)] for t in texts]
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["platt"][:] = [0.0, 2.0 if len(y) and y[0] else -2.0]
        return net
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in d], np.int64) for d in docs]
    rows, grams, counts = word_rows(list(vocab), sizes)
    starts_of = np.concatenate([[0], np.cumsum(counts)])
    fold = rng.permutation(len(docs)) % 5
    fit = np.flatnonzero(fold > 0)
    df = np.zeros((2, len(vocab)))
    for i in fit:
        df[int(y[i])][np.unique(ids[i])] += 1
    n1 = max(1, int(y[fit].sum()))
    odds = np.log((df[1] + 0.3) / (n1 + 0.6)) - np.log((df[0] + 0.3) / (len(fit) - n1 + 0.6))
    odds[df.sum(0) < 2] = 0

    def window(i: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        d = ids[i][start : start + sizes.window]
        m = np.zeros(sizes.window, bool)
        m[: len(d)] = True
        return np.pad(d, (0, sizes.window - len(d))), m

    def best(i: int, value: np.ndarray, k: int) -> list[int]:
        st = cut(len(ids[i]), sizes)
        return [st[j] for j in np.argsort(-value, kind="stable")[:k]]

    state = {k: np.zeros_like(v) for k, v in net.p.items()}
    for r in range(rounds):
        if r:
            scorer = Scorer(net, 1 << 30)
            values = dict(zip(fit, scorer.window_logits([docs[i] for i in fit])))
        else:
            values = {i: np.array([odds[ids[i][s : s + sizes.window]].clip(0).sum() for s in cut(len(ids[i]), sizes)]) for i in fit}
        chosen = []
        for i in fit:
            tops = best(i, values[i], 2 if y[i] else 1)
            if not y[i]:
                st = cut(len(ids[i]), sizes)
                tops = [*tops, st[rng.integers(len(st))]]
            chosen += [(i, s) for s in tops]
        wins = [window(i, s) for i, s in chosen]
        index, mask = np.stack([w[0] for w in wins]), np.stack([w[1] for w in wins])
        target = np.array([y[i] for i, _ in chosen], np.float32)
        pos, neg = np.flatnonzero(target == 1), np.flatnonzero(target == 0)
        batches = -(-2 * max(len(pos), len(neg)) // 128)
        for _ in range(max(epochs, -(-least_steps // batches))):
            # as many windows of either label
            n = max(len(pos), len(neg))
            order = rng.permutation(np.concatenate([x if len(x) == n else rng.choice(x, n) for x in (pos, neg)]))
            for lo in range(0, len(order), 128):
                b = order[lo : lo + 128]
                uniq, inv = np.unique(index[b], return_inverse=True)
                inv = inv.reshape(index[b].shape)
                g_idx = np.concatenate([np.arange(starts_of[u], starts_of[u + 1]) for u in uniq])
                x = net.embed(rows[uniq], grams[g_idx], counts[uniq])
                _, g, dx = net.gradient(net.gates(x), inv, mask[b], target[b])
                flat = inv.reshape(-1)
                dt = np.zeros((2, len(uniq), 3 * sizes.hidden), np.float32)
                for k in (0, 1):
                    np.add.at(dt[k], flat, dx[k].reshape(len(flat), -1))
                g["w"] = np.matmul(x.T[None], dt)
                g["b"] = dt.sum(1, keepdims=True)
                de = np.matmul(dt, net.p["w"].transpose(0, 2, 1)).sum(0)
                for k in ("bias", "out", "att", "u", "w", "b"):
                    _adagrad(net.p[k], state[k], g[k], 0.08)
                width = sizes.width
                for k, at, grad in (("word", rows[uniq], de[:, :width]), ("gram", grams[g_idx], np.repeat(de[:, width:] / counts[uniq][:, None], counts[uniq], axis=0))):
                    u2, i2 = np.unique(at, return_inverse=True)
                    total = np.zeros((len(u2), width), np.float32)
                    np.add.at(total, i2, grad)
                    state[k][u2] += total * total
                    net.p[k][u2] -= 0.08 * total / np.sqrt(state[k][u2] + 1e-8)
    _calibrate(net, docs, y, fold)
    return net


def _calibrate(net: Network, docs: list[list[str]], y: np.ndarray, fold: np.ndarray) -> None:
    """Logistic regression of the label on the highest logit, over the texts left out:
    Newton steps, halved until the penalised loss falls."""
    held = np.flatnonzero(fold == 0)
    if len(set(y[held])) < 2:
        held = np.arange(len(docs))
    logits = Scorer(net, 1 << 30).window_logits([docs[i] for i in held])
    x = np.array([[v.max(), 1.0] for v in logits], np.float64)
    t, w, pull = y[held].astype(np.float64), np.array([0.5, 0.0]), np.array([0.2, 0.2])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - t @ z + (pull * (v - [0.5, 0.0]) ** 2).sum() / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pull), x.T @ (t - p) - pull * (w - [0.5, 0.0]))
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
    net.p["platt"] = w.astype(np.float32)


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_model(docs: DataFrame, labels: DataFrame, positives: int = 800, negatives: int = 1600, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on a sample of labelled rows that is bounded by positives and negatives
    (the first of each label by a hash of the id), none of them held out. The sample and
    the training stay in a task: the driver gets the parameters, of some 2 MB."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = lambda t, n: marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = by_hash(1, positives).union(by_hash(0, negatives))
    # of bounded size: positives + negatives ids
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    got = base.join(F.broadcast(sample), "doc_id").orderBy("doc_id", "text").limit(2 * (positives + negatives)).select("text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            toxic += batch.column(1).to_pylist()
        p = train(texts, np.array(toxic, np.float32)).p
        del texts
        give_back()
        cols = [list(p), [list(v.shape) for v in p.values()], [v.astype("<f4").tobytes() for v in p.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.int32()), pa.binary()))], names=["name", "shape", "data"])

    # one task trains, not the driver, which holds the parameters only
    rows = got.coalesce(1).mapInArrow(learn, "name string, shape array<int>, data binary").collect()
    p = {r["name"]: np.frombuffer(r["data"], "<f4").reshape(r["shape"]).copy() for r in rows}
    return Network(Sizes(), p) if p else train([], np.zeros(0, np.float32))


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text over all of its overlapping windows.

    Returns one row per input row: doc_id, held_out, score (0 to 1), predicted (1 from
    0.5), then the columns named in keep. Null and empty texts are one empty window
    and get its score. Rows are scored one by one, so that order, copies and other
    columns make no difference; a null id counts as the empty id.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast((net.sizes, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, p = model.value
        scorer = Scorer(Network(sizes, p))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                s = scorer.scores([t or "" for t in part.column(0).to_pylist()])
                cols = [part.column(i) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64())], names=[*part.schema.names[1:], "score"])
        scorer.reset()
        give_back()

    base = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:]]
    scored = base.mapInArrow(run, ", ".join([*fields, "score double"]))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
