"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def digests(body: Column) -> dict[str, Column]:
    """What members look their winner up by."""
    return {"text_sha256": F.sha2(body, 256), "h2": F.xxhash64(body), "len": F.length(body)}


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Groups of rows whose white-space-normalised texts are identical.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    Three levels of combining, each grouping by the digest and the whole text, so
    that equal digests of unequal texts never meet: within a task (Spark's partial
    aggregate, whose salt is constant in a task), over each salt, and over the salt
    winners. A copy held by a third of all rows reaches the last level as one row a
    salt. Members then look their winner up by digest, a second hash and length, or, if
    winners of different texts share these, by content; adaptive execution splits a hot
    digest in that join.

    Null text counts as empty; empty texts form a group. A null id is never smaller
    than another id. Rows repeating an id and text are each reported and share the
    verdict of that id. Other columns are ignored, whatever their names.
    """
    body = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")
    base = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
    base = base.select("doc_id", "body", *[c.alias(k) for k, c in digests(F.col("body")).items()])
    key = ["text_sha256", "h2", "len"]
    salted = (
        base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy(*key, "body", "salt")
        .agg(F.min("doc_id").alias("m"), F.count("*").alias("n"))
    )
    named = salted.groupBy(*key, "body").agg(F.min("m").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = stored(named.drop("body"))
    if winners.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        out = base.drop("body").join(winners, key)
    else:
        out = base.join(named, [*key, "body"])
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
