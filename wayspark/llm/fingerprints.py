"""Canonical exact digests, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored


def _nfkc(c: Column) -> Column:
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def _folded(c: Column) -> Column:
    full = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), full).otherwise(F.lower(c))


def canonical(c: Column) -> Column:
    """NFKC, full case folding, white space of any kind folded to one space, trimmed."""
    return F.trim(F.regexp_replace(_nfkc(_folded(_nfkc(c))), r"[\s\p{Z}\x85]+", " "))


def wide_digest(c: Column) -> Column:
    """128 bits: two xxhash64 of differing seeds, 32 lower-case hex digits."""
    part = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), c)), 16, "0")
    return F.lower(F.concat(part(1), part(2)))


def clashes(texts: DataFrame) -> DataFrame:
    """Of rows (digest, canon): (digest, canon, ordinal) of the canonical texts that
    share a digest with a smaller one in byte order, ordinal from 1. Grouping by
    digest and text compares bytes in every bucket; copies combine before they move.
    """
    groups = texts.groupBy("digest", "canon").agg(F.count("*").alias("n"))
    several = groups.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest")
    if stored(several).isEmpty():
        return texts.select("digest", "canon", F.lit(0).alias("ordinal")).limit(0)
    w = W.partitionBy("digest").orderBy("canon")
    return groups.join(several, "digest").select("digest", "canon", (F.row_number().over(w) - 1).alias("ordinal")).where("ordinal > 0")


def with_next(docs: DataFrame, rows_per_bucket: int = 4000, most: int = 4096) -> DataFrame:
    """Rows (doc_id, text) with next_text, the text of the next row in ascending
    doc_id, the first row's after the last.

    Ids are cut into buckets at approximate quantiles (at most `most` bounds on the
    driver); the head of each bucket is also put behind the bucket before it, so that
    one window over buckets sees every neighbour.
    """
    spark = docs.sparkSession
    n = docs.where("doc_id IS NOT NULL").count()
    k = min(most, max(1, n // rows_per_bucket))
    at = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20000).alias("q")).first()["q"] if k > 1 else []
    bounds = sorted(set(at or []))
    bucket = F.lit(0)
    if bounds:
        # position of the id among the bounds, by halving: no list is scanned per row
        def place(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col("doc_id") <= bounds[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

        bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place(0, len(bounds)))
    dealt = docs.withColumn("bucket", bucket).withColumn("ghost", F.lit(0))
    heads = {r["bucket"]: r["m"] for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("m"), F.count_if(F.col("doc_id").isNull()).alias("z")).collect()}
    if not heads:
        return docs.withColumn("next_text", F.lit(None).cast("string"))
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    has_null = bool(docs.where("doc_id IS NULL").limit(1).count())
    ids = [v for b, v in heads.items() if v is not None and not (has_null and b == order[0])]
    first = dealt.where(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if has_null else F.lit(False)))
    rank = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    ghosts = first.withColumn("rn", F.row_number().over(rank)).where("rn = 1").drop("rn")
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    ghosts = ghosts.withColumn("bucket", to[F.col("bucket")]).withColumn("ghost", F.lit(1))
    w = W.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return (
        dealt.unionByName(ghosts.select(dealt.columns))
        .withColumn("next_text", F.lead("text").over(w))
        .where("ghost = 0")
        .drop("bucket", "ghost")
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts.

    Returns one row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A
    fingerprint is the wide digest of the canonical text; canonical texts that share
    a digest and differ in bytes get an ordinal behind it. It is an exact digest, so
    the likeness of two fingerprints is 1.0 where the canonical texts are equal byte
    by byte and 0.0 elsewhere.

    Null text counts as empty. Null ids come first; equal ids go by text. A single
    row is its own next document. An empty table gives no row. Other columns are
    ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    wide = with_next(base).select(
        "doc_id", "text", "next_text", n.alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"),
    )
    wide = wide.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"), canonical(F.col("next_text")).alias("next_canon"),
    )
    clash = clashes(base.select(canonical(F.col("text")).alias("canon")).select(wide_digest(F.col("canon")).alias("digest"), "canon"))
    fp, efp = wide_digest(F.col("canon")), wide_digest(F.col("edited_canon"))
    if not clash.isEmpty():
        def named(df: DataFrame, canon: str, out: str) -> DataFrame:
            c = clash.select(F.col("digest").alias("cd"), F.col("canon").alias("cc"), "ordinal")
            d = df.withColumn(out, wide_digest(F.col(canon)))
            return d.join(c, (d[out] == c["cd"]) & (d[canon] == c["cc"]), "left").withColumn(out, F.concat(out, F.when(F.col("ordinal").isNull(), "").otherwise(F.concat(F.lit("-"), "ordinal")))).drop("cd", "cc", "ordinal")

        wide = named(named(wide, "canon", "f"), "edited_canon", "e")
        fp, efp = F.col("f"), F.col("e")
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", fp.alias("fingerprint"), efp.alias("edited_fingerprint"),
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
        (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
    )
