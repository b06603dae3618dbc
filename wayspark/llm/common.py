"""Shared folder, stored intermediates and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where the
    session names none and runs on one machine, as in tests, a new temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        path = sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="wayspark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def give_back() -> None:
    """Return the memory that a task's objects held to the system: Python workers stay
    for later tasks, beside the executor's own memory."""
    import ctypes

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # of the GNU C library
        trim(0)


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that stored() writes meanwhile, for remove() once nothing reads them."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    The files survive lost executors and cut the lineage. A lazy result may still read
    them, so they stay until who asked for that result removes them (recorded, remove)
    or the owner of the shared folder lets them expire.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayspark/{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Have the driver forget finished queries, upon which Spark deletes their shuffle
    files: it does so when the driver collects garbage, else by the half hour. Listeners
    may hold a query for a moment after its end, and Python its plans, in cycles."""
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.2)


def _settled(now: DataFrame) -> bool:
    """Whether every vertex has one parent, which is no child itself."""
    several = now.groupBy("u").agg(F.min("v").alias("p"), F.max("v").alias("q")).where("p <> q")
    if not several.isEmpty():
        return False
    return now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (id, root) for each
    vertex that has an edge, root being the smallest id of its component.

    Large-star and small-star rounds alternate until the edges are a forest of stars.
    DataFrame functions only. Each round is linear in the edges and no component is
    gathered in one task: a vertex's least neighbour is a combined aggregate, and hubs
    are joined back on their key, where adaptive execution may split a hot one. Each
    round's edges are written to the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.union(roots.select("root", "root").distinct())
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # kept for its two uses; what an executor loses is made again from the stored edges
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).persist(StorageLevel.DISK_ONLY)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        large.unpersist()
    raise RuntimeError("components did not settle")
