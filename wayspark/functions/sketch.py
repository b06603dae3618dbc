"""Sketches as relations: each is a small table, and merging is a group-by.

Hashes come from md5, so that any engine with md5 can rebuild the same tables. Sketches
of keys are bounded by their width, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647


def hash32(c: Column, seed: int) -> Column:
    """Eight hex digits of md5(seed:value) as a whole number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c).cast("binary")), 1, 8), 16, 10).cast("bigint")


# -- Count-Min ----------------------------------------------------------------


def cms_shape(epsilon: float, delta: float) -> tuple[int, int]:
    """Width and depth for an overcount of epsilon times the mass, but for delta."""
    return math.ceil(math.e / epsilon), max(1, math.ceil(math.log(1 / delta)))


def cms_budget(memory_mb: float, depth: int, counter_bytes: int = 4) -> int:
    """The width that a memory budget allows."""
    return max(1, int(memory_mb * 1024 * 1024) // (depth * counter_bytes))


def cms(keys: DataFrame, key: str, width: int, depth: int, weight: str | None = None) -> DataFrame:
    """(row, bucket, total) of rows with a key: at most width * depth rows."""
    cells = F.array(*[F.struct(F.lit(d).alias("row"), F.pmod(hash32(F.col(key), d), F.lit(width)).alias("bucket")) for d in range(depth)])
    return keys.select(F.explode(cells).alias("c"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w")).groupBy("c.row", "c.bucket").agg(F.sum("w").alias("total"))


def cms_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "bucket").agg(F.sum("total").alias("total"))


def cms_estimate(sketch: DataFrame, keys: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """keys with estimate, never below the true total."""
    cells = F.array(*[F.struct(F.lit(d).alias("row"), F.pmod(hash32(F.col(key), d), F.lit(width)).alias("bucket")) for d in range(depth)])
    probes = keys.select(key, F.explode(cells).alias("c")).select(key, "c.row", "c.bucket")
    return probes.join(sketch, ["row", "bucket"], "left").groupBy(key).agg(F.min(F.coalesce("total", F.lit(0))).alias("estimate"))


# -- Bloom --------------------------------------------------------------------


def bloom_shape(n: int, error: float) -> tuple[int, int]:
    """Bits, rounded up to bytes, and hashes for n keys."""
    m = math.ceil(-max(1, n) * math.log(error) / math.log(2) ** 2)
    m = (m + 7) // 8 * 8
    return m, max(1, round(m / max(1, n) * math.log(2)))


def _bits(key: str, m: int, k: int) -> Column:
    one, two = hash32(F.col(key), 101), hash32(F.col(key), 202)
    return F.array_distinct(F.array(*[F.pmod(one + two * i, F.lit(m)) for i in range(k)]))


def bloom(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """The set bits."""
    return keys.select(F.explode(_bits(key, m, k)).alias("bit")).distinct()


def bloom_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def bloom_test(bits: DataFrame, keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """keys with maybe: whether all of a key's bits are set."""
    probes = keys.select(key).distinct().select(key, F.explode(_bits(key, m, k)).alias("bit"))
    hit = bits.withColumn("hit", F.lit(1))
    return probes.join(hit, "bit", "left").groupBy(key).agg((F.count("*") == F.count("hit")).alias("maybe"))


# -- HyperLogLog --------------------------------------------------------------


def hll(rows: DataFrame, group: list[str], value: str, b: int) -> DataFrame:
    """(group, register, rank): at most 2^b registers a group."""
    h = hash32(F.col(value), 7)
    rest = F.floor(h / (1 << b)).cast("bigint")
    # place of the lowest set bit among the other 32 - b bits
    rank = F.coalesce(*[F.when(F.pmod(rest, F.lit(1 << (i + 1))) != 0, F.lit(i + 1)) for i in range(32 - b)], F.lit(33 - b))
    return rows.groupBy(*group, F.pmod(h, F.lit(1 << b)).alias("register")).agg(F.max(rank).alias("rank"))


def hll_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if c != "rank"]
    return a.unionByName(b).groupBy(*keys).agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, group: list[str], b: int) -> DataFrame:
    """(group, estimate), by linear counting while registers are empty and the raw
    estimate is small."""
    m = 1 << b
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    agg = registers.groupBy(*group).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("used"))
    raw = F.lit(alpha * m * m) / (F.col("s") + (m - F.col("used")))
    linear = m * F.log(F.lit(float(m)) / (m - F.col("used")))
    return agg.select(*group, F.when((raw <= 2.5 * m) & (F.col("used") < m), linear).otherwise(raw).alias("estimate"))


def distinct_count(rows: DataFrame, group: list[str], value: str, b: int, exact_up_to: int = 64) -> DataFrame:
    """Distinct values by group: exact up to a bound, estimated beyond."""
    small = rows.groupBy(*group).agg(F.count_distinct(value).alias("exact"))
    return small.join(hll_estimate(hll(rows, group, value, b), group, b), group).select(*group, F.when(F.col("exact") <= exact_up_to, F.col("exact").cast("double")).otherwise(F.col("estimate")).alias("n_distinct"))


# -- MinHash ------------------------------------------------------------------


def minhash(rows: DataFrame, group: list[str], item: str, hashes: int, seed: int = 42) -> DataFrame:
    """(group, i, value): the least of each universal hash over a group's items."""
    base = F.pmod(hash32(F.col(item), seed), F.lit(PRIME))
    tagged = rows.select(*group, base.alias("x")).select(*group, "x", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("i"))
    a, c = _coefficients(F.col("i"))
    return tagged.groupBy(*group, "i").agg(F.min(F.pmod(a * F.col("x") + c, F.lit(PRIME))).alias("value"))


def _coefficients(i: Column) -> tuple[Column, Column]:
    """Multipliers and shifts below 2^31 from the index alone."""
    i = i.cast("bigint") + 1
    return F.pmod(i * 1103515245 + 12345, F.lit(PRIME - 1)) + 1, F.pmod(i * 22695477 + 1, F.lit(PRIME))


def bands(signature: DataFrame, group: list[str], rows_per_band: int) -> DataFrame:
    """(group, band, key) of a signature."""
    band = F.floor(F.col("i") / rows_per_band).cast("int")
    return signature.groupBy(*group, band.alias("band")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"].cast("string")), ":").alias("key"))


def lsh_threshold(n_bands: int, rows_per_band: int) -> float:
    return (1 / n_bands) ** (1 / rows_per_band)
