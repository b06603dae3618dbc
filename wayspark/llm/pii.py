"""Personal data: base kinds by pattern, further spans by bootstrapped contexts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs of digits are consumed whole, also where no address or number follows, so
# that long ones are read once
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: A token that may be an identifier: holds a digit, or an at sign between letters.
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
_EDGE = "\"'`.,;:!?()[]{}<>|*#%&$="


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if m.group(1) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """Letters a, digits 9, runs collapsed: the lexical shape of a token."""
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", token))


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int, str]]:
    """(start, end, pattern, instance, kind) of identifier-like tokens, one for each of
    a token's patterns: hashes of one or two words to the left, of two to the right, of
    one on either side, all lower case, and of the word to the left with the token's
    shape. kind is the base kind that the token belongs to, or empty. Base spans are
    instances of their own; the tokens that they touch are not looked at again. Words
    are read in the 128 characters on either side."""
    out = []

    def add(a: int, b: int, kind: str) -> None:
        left = [w for x in text[max(0, a - 128) : a].split()[-2:] if (w := x.strip("*#%&$|").lower())]
        right = [w for x in text[b : b + 128].split()[:3] if (w := x.strip(_EDGE).lower())][:2]
        contexts = []
        if left:
            contexts += [("l", left[-1]), ("s", left[-1], shape(text[a:b]))]
        if len(left) == 2:
            contexts.append(("ll", *left))
        if len(right) == 2:
            contexts.append(("rr", *right))
        if left and right:
            contexts.append(("lr", left[-1], right[0]))
        h = xxhash.xxh3_64_intdigest
        instance = h(text[a:b]) - (1 << 63)
        for c in contexts:
            out.append((a, b, h("\x00".join(c)) - (1 << 63), instance, kind))

    for kind, a, b in spans:
        add(a, b, kind)
    if "@" in text or _DIGIT.search(text):
        taken = sorted((a, b) for _, a, b in spans)
        k = 0
        for m in _TOKEN.finditer(text):
            raw = m.group()
            left = len(raw) - len(raw.lstrip(_EDGE))
            a, b = m.start() + left, m.start() + len(raw.rstrip(_EDGE))
            if b <= a:
                continue
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k < len(taken) and taken[k][0] < b:
                continue
            add(a, b, "")
    return out


def _text_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def extract(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 20, confidence: float = 0.9, seeds: int = 3, damping: float = 0.5
) -> DataFrame:
    """Spans of personal data.

    Returns one row per input row: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans. Base spans come from the four patterns. They seed contexts:
    a pattern (words to the left, to the right or on both sides; the token's shape is
    in one of five) is scored by the share of its distinct instances that are held for
    personal data, an instance by the best pattern that it occurs with, in turns over the
    whole corpus, until no score changes (or for `rounds` turns). Instances of a pattern of at least `confidence`, with `seeds` distinct
    held instances or more, are held in the next turn and seed further patterns. Tokens
    that no base kind covers and that stand in such a pattern at the end are added, under
    the kind that most of their patterns have, with a leading x_, behind the base spans.

    Null text counts as empty and has no span. Rows with equal or null ids keep their
    own spans. Very long texts are read in time linear in their length. Other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                spans = base_spans(t)
                n = [0, 0, 0, 0]
                for kind, _, _ in spans:
                    n[KINDS.index(kind)] += 1
                text = _text_of(spans)
                occ = [{"a": a, "b": b, "p": p, "i": i, "k": k} for a, b, p, i, k in occurrences(t, spans)]
                rows.append((*n, hashlib.sha256(text.encode()).hexdigest(), text, occ))
            cols = list(zip(*rows)) if rows else [[]] * 7
            occ_t = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("p", pa.int64()), ("i", pa.int64()), ("k", pa.string())]))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), occ_t]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "occ"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, occ array<struct<a:int,b:int,p:bigint,i:bigint,k:string>>"
    )
    found = stored(found.withColumn("row", F.monotonically_increasing_id()))
    spots = found.select("row", F.explode("occ").alias("o")).select("row", "o.*")
    good = score_patterns(spots, rounds, confidence, seeds, damping)
    more = (
        spots.where("k = ''")
        .join(good, "p")
        .groupBy("row", "a", "b", "kind")
        .agg(F.count("*").alias("n"))
        .groupBy("row", "a", "b")
        .agg(F.max(F.struct("n", "kind"))["kind"].alias("kind"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("kind").alias("kind"), "a", "b"))).alias("more"))
    )
    extra = F.transform("more", lambda s: F.concat(F.lit("x_"), s["kind"], F.lit(":"), s["a"], F.lit(":"), s["b"]))
    return found.join(more, "row", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more").isNotNull(), F.array_join(extra, ","))).alias("spans"),
    )


def score_patterns(spots: DataFrame, rounds: int, confidence: float, seeds: int, damping: float) -> DataFrame:
    """Patterns (p, kind) of high confidence, from occurrences (p, i, k).

    The graph has one edge for each distinct pattern and instance. Base seeds keep score
    1; other instances start at 0 and take the best confidence of their patterns, while a
    pattern's confidence is the mean score of its instances. Where the pattern is of
    `confidence` and has enough held instances, its instances are held with its whole
    confidence and kind, otherwise they take it damped.
    """
    edges = spots.groupBy("p", "i").agg(F.max("k").alias("k"))
    # a pattern of fewer instances can't have enough that are held
    wide = edges.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= seeds).select("p")
    live = stored(edges.join(wide, "p"))
    base = F.max(F.when(F.col("k") != "", F.col("k"))).alias("held")
    scores = live.groupBy("i").agg(base).select("i", F.when(F.col("held").isNull(), 0.0).otherwise(1.0).alias("s"), "held")

    def patterns() -> DataFrame:
        """(p, c, kind): kind is null where too few instances are held."""
        by_kind = live.select("p", "i").join(scores, "i").groupBy("p", "held").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
        held = F.when(F.col("held").isNotNull(), F.col("n"))
        whole = by_kind.groupBy("p").agg((F.sum("s") / F.sum("n")).alias("c"), F.sum(held).alias("n_held"), F.max(F.when(F.col("held").isNotNull(), F.struct("n", "held"))).alias("best"))
        return whole.select("p", "c", F.when((F.col("n_held") >= seeds) & (F.col("c") >= confidence), F.col("best.held")).alias("kind"))

    before = None
    for _ in range(rounds):
        now = scores.agg(F.count("held"), F.round(F.sum("s"), 6)).first()
        if now == before:
            break
        before = now
        score = F.when(F.col("kind").isNotNull(), F.col("c")).otherwise(F.col("c") * damping)
        found = live.join(patterns(), "p").groupBy("i").agg(base, F.max(score).alias("best"), F.max(F.when(F.col("kind").isNotNull(), F.struct("c", "kind"))).alias("sure"))
        scores = stored(found.select("i", F.when(F.col("held").isNotNull(), 1.0).otherwise(F.coalesce("sure.c", "best")).alias("s"), F.coalesce("held", "sure.kind").alias("held")))
    return patterns().where("kind IS NOT NULL").select("p", "kind")
