"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

_UNIT = "CAST(conv(substr(md5(concat('mix-{seed}:', CAST(doc_id AS STRING))), 1, 13), 16, 10) AS BIGINT)"

#: Shares of the sources, the same text for both engines: caps are cap_factor times
#: the size, and the level is the largest of the levels that arise as sources are
#: capped one after another, least room first.
_LEVELS = """
ranked AS (
  SELECT source, source_size, {cap} * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes),
levels AS (
  SELECT source, source_size, cap, weight,
         ({share} * CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), greatest(0e0, max(level) OVER ()) * weight) AS target
  FROM levels)
"""

_QUALITY_NUM = r"[^\p{L}\x20\x09-\x0D]"

ORACLE_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size,
         CASE WHEN 100 * length(regexp_replace(coalesce(text, ''), '[^\p{L}\x20\x09-\x0D]', '', 'g')) >= 97 * length(coalesce(text, '')) THEN 4
              WHEN 100 * length(regexp_replace(coalesce(text, ''), '[^\p{L}\x20\x09-\x0D]', '', 'g')) >= 90 * length(coalesce(text, '')) THEN 2
              ELSE 1 END AS quality,
         (CAST(CAST('0x' || substr(md5('mix-17:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
"""
    + _LEVELS.format(cap=2, share="1.5")
    + """,
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
         CASE quality WHEN 4 THEN sqrt(sqrt(u)) WHEN 2 THEN sqrt(u) ELSE u END AS rank_key
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
s AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs,
         sum(size) OVER (PARTITION BY source ORDER BY rank_key DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM r)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM s
"""
)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: int = 2,
    seed: int = 17,
    buckets: int = 4096,
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns one row per input row: doc_id, source, size, source_size, target, taken.
    A source's target fills complete epochs first; the rest goes to documents in the
    order of their Efraimidis-Spirakis keys, -ln(u) / quality ascending, until their
    words fill it; the document at the edge gives the words still missing. u comes
    from a digest of the id, so that reruns agree; quality is 4, 2 or 1 by the share
    of letters and white space in the text. The key is kept as u^(1/quality), which
    falls as the exponential key rises and needs square roots only.

    No source is sorted as a whole: words are summed in buckets of the key, the
    prefix sum runs over buckets, and only the bucket at the edge is sorted.

    Null text has size 0; a null source is a source of its own, last; a null id draws
    as the empty id. Equal keys go by id, then size. An empty table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.length(F.regexp_replace(text, _QUALITY_NUM, "")) * 100
    narrow = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
            F.when(plain >= F.length(text) * 97, 4).when(plain >= F.length(text) * 90, 2).otherwise(1).alias("quality"),
        )
        .withColumn("doc_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        .withColumn("u", (F.expr(_UNIT.format(seed=seed).replace("CAST(doc_id AS STRING)", "doc_key")).cast("double") + 0.5) / F.lit(float(2**52)))
        .withColumn("rank_key", F.when(F.col("quality") == 4, F.sqrt(F.sqrt("u"))).when(F.col("quality") == 2, F.sqrt("u")).otherwise(F.col("u")))
        .withColumn("exp_key", -F.log("u") / F.col("quality"))
        .withColumn("bucket", F.floor((1 - F.col("rank_key")) * buckets).cast("int"))
        .drop("u", "doc_key")
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = spark.sql("WITH " + _LEVELS.format(cap=cap, share=repr(float(share))).strip().replace("FROM sizes", "FROM {sizes}") + " SELECT * FROM targets", sizes=sizes)
    targets = stored(
        targets.withColumn("epochs", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint"))
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    hist = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = spark.sql(
        "SELECT source, bucket, words, sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {hist}",
        hist=hist,
    )
    edge = (
        run.join(targets, same(run, targets), "inner")
        .where("upto > rest")
        .groupBy(targets["source"].alias("source"))
        .agg(F.min(F.struct("bucket", F.expr("upto - words").alias("before"))).alias("edge"))
    )
    plan = targets.join(edge, same(targets, edge), "left").select(
        targets["source"], "source_size", "target", "epochs", "rest", F.coalesce("edge.bucket", F.lit(buckets + 1)).alias("edge_bucket"), F.coalesce("edge.before", F.lit(0)).alias("edge_before")
    )
    plan = stored(plan)
    rows = narrow.join(plan, same(narrow, plan), "inner").drop(plan["source"])
    away = rows.where("bucket <> edge_bucket").withColumn("part", F.when(F.col("bucket") < F.col("edge_bucket"), F.col("size")).otherwise(F.lit(0)))
    at = spark.sql(
        "SELECT *, greatest(0, least(size, rest - edge_before - (sum(size) OVER (PARTITION BY source ORDER BY rank_key DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size))) AS part FROM {at}",
        at=rows.where("bucket = edge_bucket"),
    )
    return away.unionByName(at).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("bigint").alias("taken"), "exp_key"
    )
