"""Matching corridors against trips: occurrences by equi-join, chained by ranges.

A corridor is a row (corridor, segments array<array<string>>). A trip supports it if the
segments stand in it contiguously, in order, with at most max_gap cells between one's
end and the next one's start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspark.functions import seq
from wayspark.sources import io


#: Cells of a segment's key. A busy cell is in many keys, each as rare as the way it starts.
_KEY = 3
#: Numbers of 64 trips in a bitmap, a power of two.
_WIDTH = 16


def _segments(corridors: DataFrame) -> DataFrame:
    """(corridor, n_segs, ids): the segments of each corridor, as one string each."""
    return corridors.select("corridor", F.size("segments").alias("n_segs"), F.transform("segments", seq.key).alias("ids"))


def occurrences(trips: DataFrame, corridors: DataFrame) -> DataFrame:
    """(trip_id, seg, at, stop) of every place where a segment of any corridor stands,
    each distinct segment once, whichever corridors have it.

    Segments meet trips on their first cells, three of them where they have as many.
    Places carry no cells: those of longer segments are looked up by trip afterwards.
    Neither side is broadcast by hand: which one is small is Spark's to see."""
    segs = corridors.select(F.explode("segments").alias("cells")).where(F.size("cells") > 0).select(seq.key(F.col("cells")).alias("seg"), "cells").dropDuplicates(["seg"])
    segs = segs.select("seg", F.col("cells").alias("way"), F.size("cells").alias("n"), seq.key(F.slice("cells", 1, _KEY)).alias("key"))
    heads = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(_KEY), F.size("cells") - i)), lambda n: seq.key(F.slice("cells", i + 1, n)))
    places = trips.where(F.size("cells") > 0).select("trip_id", F.posexplode(F.transform("cells", lambda x, i: heads(i))).alias("at", "keys"))
    hit = places.select("trip_id", "at", F.explode("keys").alias("key")).join(segs, "key").select("trip_id", "at", "seg", "way", "n")
    whole = hit.where(F.col("n") <= _KEY)
    long = hit.where(F.col("n") > _KEY).join(trips.select("trip_id", "cells"), "trip_id").where(F.slice("cells", F.col("at") + 1, F.col("n")) == F.col("way"))
    return whole.select("trip_id", "seg", "at", (F.col("at") + F.col("n")).alias("stop")).unionByName(long.select("trip_id", "seg", "at", (F.col("at") + F.col("n")).alias("stop")))


def spans(trips: DataFrame, corridors: DataFrame, max_gap: int, most_segments: int | None = None, written: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(trip_id, corridor, start, stop): per supporting trip the earliest start, then
    the least end.

    Corridors are read as a trie of their segments, so that what many of them begin with
    is followed once: a beginning, with every end that it reaches in a trip and the best
    start of that end, meets the trip's occurrences within the gap, and goes on where
    the trie does. With `written`, which puts a frame aside and reads it, no plan is of
    more than one step, however many segments there are."""
    occ = written(occurrences(trips, corridors))
    named = _segments(corridors)
    n = most_segments if most_segments is not None else (named.agg(F.max("n_segs")).first()[0] or 0)
    begun = lambda i: F.array_join(F.slice("ids", 1, i), " ~ ")
    first = named.where("n_segs >= 1").select(begun(1).alias("seg")).distinct()
    reach = occ.join(first, "seg", "left_semi").select("trip_id", F.col("seg").alias("begun"), F.col("at").alias("start"), "stop")
    ended = lambda r, i: r.join(named.where(F.col("n_segs") == i).select(begun(i).alias("begun"), "corridor"), "begun").select("trip_id", "corridor", "start", "stop")
    done = ended(reach, 1)
    nxt = occ.select("trip_id", F.col("seg").alias("__seg"), F.col("at").alias("__at"), F.col("stop").alias("__stop"))
    for i in range(1, n):
        trie = named.where(F.col("n_segs") > i).select(begun(i).alias("begun"), F.get("ids", F.lit(i)).alias("__seg"), begun(i + 1).alias("__to")).distinct()
        reach = (
            reach.join(trie.select("begun").distinct(), "begun", "left_semi")
            .join(nxt.join(trie.select("__seg").distinct(), "__seg", "left_semi"), "trip_id")
            .where(F.col("__at").between(F.col("stop"), F.col("stop") + max_gap))
            .join(trie, ["begun", "__seg"])
            .groupBy("trip_id", F.col("__to").alias("begun"), F.col("__stop").alias("stop"))
            .agg(F.min("start").alias("start"))
            .select("trip_id", "begun", "start", "stop")
        )
        reach = written(reach)
        done = done.unionByName(ended(reach, i + 1))
    # the earliest start, then the least end, as one number
    both = F.min(F.col("start").cast("bigint") * (1 << 31) + F.col("stop"))
    best = done.groupBy("trip_id", "corridor").agg(both.alias("s"))
    return best.select("trip_id", "corridor", F.shiftright("s", 31).cast("int").alias("start"), F.col("s").bitwiseAND(F.lit((1 << 31) - 1).cast("bigint")).cast("int").alias("stop"))


def support(trips: DataFrame, corridors: DataFrame, max_gap: int, most_segments: int | None = None) -> DataFrame:
    """(corridor, support): distinct trips, 0 where none."""
    s = spans(trips, corridors, max_gap, most_segments).groupBy("corridor").agg(F.count("*").alias("support"))
    return corridors.select("corridor").join(s, "corridor", "left").select("corridor", F.coalesce("support", F.lit(0)).alias("support"))


def verify(trips: DataFrame, corridors: DataFrame, max_gap: int, most_segments: int | None = None) -> DataFrame:
    """Exact support and the supporting trips' means; speed is total distance over
    total time."""
    hit = spans(trips, corridors, max_gap, most_segments).select("trip_id", "corridor").join(trips.select("trip_id", "duration_sec", "distance_km"), "trip_id")
    g = hit.groupBy("corridor").agg(F.count("*").alias("support"), F.sum("duration_sec").alias("sec"), F.sum("distance_km").alias("km"))
    return g.select(
        "corridor", "support", F.round(F.col("sec") / F.col("support"), 1).alias("mean_duration_sec"), F.round(F.col("km") / F.col("support"), 3).alias("mean_distance_km"),
        F.when(F.col("sec") > 0, F.round(F.col("km") / (F.col("sec") / 3600.0), 2)).otherwise(0.0).alias("mean_speed_kmh"),
    )


def subset(trips: DataFrame, corridors: DataFrame) -> DataFrame:
    """(corridor, trips): trips that visit all of a corridor's cells, in any order.

    Trips of the same cells are one row with their number. Each meets the segments'
    cells; a segment's trips are then bitmaps over chunks of trips of one number, and
    corridors are followed as a trie of segments, whose bitmaps are intersected chunk by
    chunk and counted where they meet: no row stands for one trip and one corridor, nor
    for one corridor and a chunk that it isn't in. What is read again is written."""
    spark = trips.sparkSession

    def written(df: DataFrame) -> DataFrame:
        df.write.parquet(path := io.scratch(spark))
        return spark.read.parquet(path)

    each = F.filter(F.transform("segments", lambda s: F.array_sort(F.array_distinct(s))), lambda s: F.size(s) > 0)
    named = corridors.where(F.forall(F.flatten("segments"), lambda c: c.isNotNull())).select("corridor", F.array_sort(F.array_distinct(each)).alias("parts"))
    named = written(named.where(F.size("parts") > 0).select("corridor", "parts", F.array_sort(F.transform("parts", seq.key)).alias("ids")))
    segs = named.select(F.explode("parts").alias("part")).distinct()
    segs = segs.select(seq.key(F.col("part")).alias("seg"), F.get("part", F.lit(0)).alias("one"), F.coalesce(F.get("part", F.lit(1)), F.get("part", F.lit(0))).alias("two"), F.slice("part", 3, F.size("part")).alias("rest"))
    sets = trips.groupBy("trip_id").agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("cells"))))).alias("cells"))
    # numbered once, as a number is another whenever it is made again
    sets = sets.groupBy("cells").agg(F.count("*").alias("n")).sortWithinPartitions("n", "cells")
    sets = written(sets.withColumn("set", F.monotonically_increasing_id()))
    begin = sets.select("*", F.explode("cells").alias("one")).join(segs.groupBy("one").agg(F.collect_set("two").alias("twos")), "one")
    begin = begin.select("set", "n", "cells", "one", F.explode(F.array_intersect("twos", "cells")).alias("two"))
    # the next cell alone settles most, and costs less
    rest = (F.size("rest") == 0) | (F.array_contains("cells", F.get("rest", F.lit(0))) & (F.size(F.array_except("rest", "cells")) == 0))
    held = written(begin.join(segs, ["one", "two"]).where(rest).select("set", "n", "seg"))
    counts = held.groupBy(F.col("seg").alias("begun")).agg(F.sum("n").alias("trips"))
    begun = lambda i: F.array_join(F.slice("ids", 1, i), " ~ ")
    most = named.agg(F.max(F.size("ids"))).first()[0] or 0
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("set").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    at = F.shiftright("set", 6).bitwiseAND(F.lit(_WIDTH - 1).cast("bigint"))
    bits = [f"b{i}" for i in range(_WIDTH)]
    used = named.where(F.size("ids") > 1).select(F.explode("ids").alias("seg")).distinct()
    chunks = held.join(used, "seg", "left_semi").groupBy("seg", "n", F.floor(F.col("set") / (64 * _WIDTH)).alias("chunk"))
    chunks = written(chunks.agg(*[F.bit_or(F.when(at == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(b) for i, b in enumerate(bits)])) if most > 1 else None
    reach = chunks.select("*", F.col("seg").alias("begun")).withColumnRenamed("seg", "last") if most > 1 else None
    for i in range(1, most):
        trie = named.where(F.size("ids") > i).select(begun(i).alias("begun"), F.get("ids", F.lit(i)).alias("seg"), begun(i + 1).alias("to")).distinct()
        nxt = chunks.join(trie.select("seg").distinct(), "seg", "left_semi").select("seg", "n", "chunk", *[F.col(b).alias(f"__{b}") for b in bits])
        met = reach.join(trie.select("begun").distinct(), "begun", "left_semi").join(nxt, ["n", "chunk"]).where("seg > last")
        met = met.select("begun", "seg", "n", "chunk", *[F.col(b).bitwiseAND(F.col(f"__{b}")).alias(b) for b in bits])
        size = sum((F.bit_count(b) for b in bits), F.lit(0))
        found = met.groupBy("begun", "seg").agg(F.sum(size * F.col("n")).alias("trips")).where("trips > 0")
        counts = counts.unionByName(found.join(trie, ["begun", "seg"]).select(F.col("to").alias("begun"), "trips"))
        if i + 1 < most:
            # behind a generator, as constraints of filtered aliases double with each of them
            kept = met.select("begun", "seg", "n", "chunk", F.inline(F.array(F.struct(*bits)))).where(size > 0)
            reach = kept.join(trie, ["begun", "seg"]).select("n", "chunk", *bits, F.col("to").alias("begun"), F.col("seg").alias("last"))
    return named.select("corridor", F.array_join("ids", " ~ ").alias("begun")).join(counts, "begun").select("corridor", "trips")


def greedy(trips: DataFrame, corridors: DataFrame, max_gap: int) -> DataFrame:
    """(trip_id, corridor, start, stop) by taking each segment's earliest place; a
    lower bound of spans()."""
    pairs = trips.select("trip_id", "cells").join(spans(trips, corridors, max_gap).select("trip_id", "corridor"), "trip_id").join(corridors, "corridor")

    def step(acc, seg):
        at = F.when(acc["stop"] >= 0, seq.first_at(F.col("cells"), seg, acc["stop"] + 1))
        ok = at.isNotNull() & ((acc["start"] < 0) | (at - 1 - acc["stop"] <= max_gap))
        return F.struct(F.when(~ok, -1).when(acc["start"] < 0, at - 1).otherwise(acc["start"]).cast("int").alias("start"), F.when(ok, at - 1 + F.size(seg)).otherwise(-1).cast("int").alias("stop"))

    zero = F.struct(F.lit(-1).cast("int").alias("start"), F.lit(0).cast("int").alias("stop"))
    return pairs.withColumn("g", F.aggregate("segments", zero, step)).where("g.stop >= 0").select("trip_id", "corridor", "g.start", "g.stop")
