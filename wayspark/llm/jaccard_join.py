"""N-gram Jaccard join with signature trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, freed, give_back, recorded, remove, stored

_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `width` words; the whole
    sequence where there are fewer words; none without words. A-Z is lower-cased and
    words are cut at ASCII white space, as bytes.lower and bytes.split do."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _ODD[i % 5] + h[i : len(words) - k + 1 + i])
    return np.unique(out)


class Levels:
    """Size classes and the partition of the hash space of each: two sets of at least
    the similarity differ in at most `differ` elements, so that of differ + 1 + spare
    parts more than `spare` are equal, and one that isn't empty unless a set has more
    empty parts than that; such a set also offers its empty parts."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the similarity is num / den, above 0 and at most 1")
        self.num, self.den = num, den
        self.starts = [1, 2]
        self.parts: dict[int, tuple[int, int]] = {}

    def level_of(self, n: int) -> int:
        while self.starts[-1] <= n:
            # a set and a larger one that may be as similar are in one class or in neighbours
            x = self.starts[-1]
            self.starts.append(max(x + 1, math.ceil(x * 1.4), -(-x * self.den // self.num)))
        import bisect

        return bisect.bisect_right(self.starts, n) - 1

    def shape(self, level: int) -> tuple[int, int]:
        """Parts and spare parts of a level."""
        if level not in self.parts:
            self.level_of(self.starts[-1])
            while len(self.starts) <= level + 1:
                self.level_of(self.starts[-1])
            most = self.starts[level + 1] - 1
            differ = 2 * most * (self.den - self.num) // (self.den + self.num)
            least = max(1, self.starts[level] * self.num // self.den)
            spare = math.ceil(1.5 * (differ + 1) * math.exp(-least / (differ + 1))) + 1 if differ else 0
            self.parts[level] = (differ + 1 + spare, spare)
        return self.parts[level]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Digests of the parts of a set, at its level and, where a larger set of the
        next class may be as similar, at the next."""
        n = len(s)
        if not n:
            return np.empty(0, np.uint64)
        level = self.level_of(n)
        self.shape(level + 1)
        levels = [level]
        if n * self.den >= self.num * self.starts[level + 1]:
            levels.append(level + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s))])
        out = []
        for x in levels:
            k, spare = self.shape(x)
            step = (1 << 64) // k
            bounds = np.searchsorted(s, np.arange(1, k, dtype=np.uint64) * _U(step)) if k > 1 else np.empty(0, np.int64)
            at = np.concatenate([[0], bounds, [n]])
            digest = sums[at[1:]] - sums[at[:-1]]
            full = at[1:] > at[:-1]
            sig = _mix(_mix(digest) + _mix(np.arange(k, dtype=np.uint64) + _U(x << 32)))
            out.append(sig if k - full.sum() > spare else sig[full])
        return np.concatenate(out)


    def bits(self, level: int) -> int:
        """Length of the bitmaps of a level's sets: at least twice the largest size."""
        while len(self.starts) <= level + 1:
            self.level_of(self.starts[-1])
        return 1 << max(8, (2 * (self.starts[level + 1] - 1)).bit_length())

    def columns(self, n: Column, most: int = 1 << 40) -> Column:
        """The levels that a set of n elements is in, as an array column."""
        while self.starts[-1] <= most:
            self.level_of(self.starts[-1])
        starts = F.array(*[F.lit(x).cast("bigint") for x in self.starts])
        level = F.size(F.filter(starts, lambda x: x <= n)) - 1
        return F.when(n * self.den >= F.get(starts, level + 1) * self.num, F.array(level, level + 1)).otherwise(F.array(level))


# -- signature trees ----------------------------------------------------------


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


class _Node:
    __slots__ = ("kids", "members", "bits", "low", "high", "slack", "one")

    def __init__(self, kids, members, bits, low, high, slack) -> None:
        self.kids, self.members, self.bits, self.low, self.high, self.slack, self.one = kids, members, bits, low, high, slack, False


def bitmap(s: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits of a set's tokens, as 64-bit words."""
    out = np.zeros(n_bits // 64, np.uint64)
    b = s & _U(n_bits - 1)
    np.bitwise_or.at(out, (b >> _U(6)).astype(np.int64), _U(1) << (b & _U(63)))
    return out


class SignatureTree:
    """Sets under a tree: a node holds the OR of its sets' token bitmaps, the range of
    their sizes, and the most tokens of one set that share a bit with another. The
    dual traversal drops a pair of nodes if no pair of sets below can overlap enough:
    common tokens are at most the common bits and the smaller slack. It also drops a
    pair whose sets are all in one component, as only components are asked for.

    With `sets`, the links are exact, and `known` components grow by them. Without, the
    tree has `bitmaps` and `sizes` only, and its links are the pairs of sets of different
    components that their bitmaps leave open; with `sides`, 0 or 1, the pairs of one side
    with the other. Leaves grow with the number of sets, from 4 to 64, which only weighs
    numpy's work against Python's. `dropped` counts pairs of nodes."""

    def __init__(
        self,
        sets: list[np.ndarray] | None,
        num: int,
        den: int,
        known: list[int] | None = None,
        leaf: int | None = None,
        fan: int = 4,
        bitmaps: np.ndarray | None = None,
        sizes: np.ndarray | None = None,
        sides: np.ndarray | None = None,
    ) -> None:
        self.sets, self.num, self.den = sets, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64) if sets is not None else sizes
        self.union = _Union(len(self.sizes))
        self.links: list[tuple[int, int]] = []
        self.dropped = 0
        self.known = np.arange(len(self.sizes))
        if known is not None:
            first: dict[int, int] = {}
            for i, c in enumerate(known):
                j = first.setdefault(c, i)
                if j != i:
                    self.union.up[i] = self.known[i] = j
        if sets is not None:
            n_bits = 1 << max(8, min(16, int(self.sizes.max() * 2).bit_length()))
            bitmaps = np.stack([bitmap(s, n_bits) for s in sets])
            key = lambda i: (int(sets[i][0]), len(sets[i]), i)
        else:
            key = lambda i: (int(sizes[i]), bitmaps[i].tobytes(), i)
        self.bitmaps = bitmaps
        self.slacks = self.sizes - np.bitwise_count(self.bitmaps).sum(1)
        leaf = leaf or max(4, min(64, len(self.sizes) // 64))

        def root(order: list[int]) -> _Node:
            level = [self._leaf(order[i : i + leaf]) for i in range(0, len(order), leaf)]
            while len(level) > 1:
                level = [self._inner(level[i : i + fan]) for i in range(0, len(level), fan)]
            return level[0]

        # alike sets have, mostly, the same least token, or else about the same size
        order = sorted(range(len(self.sizes)), key=key)
        if sides is None:
            self.start = [(x := root(order), x)]
        else:
            both = [[i for i in order if sides[i] == k] for k in (0, 1)]
            self.start = [(root(both[0]), root(both[1]))] if both[0] and both[1] else []

    def _leaf(self, members: list[int]) -> _Node:
        m = np.array(members)
        return _Node(None, m, np.bitwise_or.reduce(self.bitmaps[m], axis=0), int(self.sizes[m].min()), int(self.sizes[m].max()), int(self.slacks[m].max()))

    def _inner(self, kids: list[_Node]) -> _Node:
        return _Node(kids, None, np.bitwise_or.reduce([k.bits for k in kids], axis=0), min(k.low for k in kids), max(k.high for k in kids), max(k.slack for k in kids))

    def _some(self, x: _Node) -> int:
        while x.kids is not None:
            x = x.kids[0]
        return int(x.members[0])

    def _one(self, x: _Node) -> bool:
        """Whether all sets below are in one component; once true, always true."""
        if not x.one:
            find = self.union.find
            if x.kids is None:
                r = find(int(x.members[0]))
                x.one = all(find(int(i)) == r for i in x.members)
            elif all(self._one(k) for k in x.kids):
                r = find(self._some(x.kids[0]))
                x.one = all(find(self._some(k)) == r for k in x.kids)
        return x.one

    def _hopeless(self, x: _Node, y: _Node) -> bool:
        if x.high * self.den < y.low * self.num or y.high * self.den < x.low * self.num:
            return True
        most = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.slack, y.slack)
        return most * (self.den + self.num) < self.num * (x.low + y.low)

    def join(self) -> list[tuple[int, int]]:
        """Links that connect every component, not every link inside one; without sets,
        all open pairs of different components."""
        stack = list(self.start)
        find = self.union.find
        while stack:
            x, y = stack.pop()
            if self._one(x) and (x is y or (self._one(y) and find(self._some(x)) == find(self._some(y)))):
                continue
            if x is not y and self._hopeless(x, y):
                self.dropped += 1
                continue
            if x.kids is None and y.kids is None:
                self._leaves(x, y)
            elif x is y:
                stack += [(a, b) for i, a in enumerate(x.kids) for b in x.kids[i + 1 :]] + [(a, a) for a in x.kids]
            elif y.kids is None or (x.kids is not None and x.high >= y.high):
                stack += [(a, y) for a in x.kids]
            else:
                stack += [(x, b) for b in y.kids]
        return self.links

    def _leaves(self, x: _Node, y: _Node) -> None:
        a, b = x.members, y.members
        common = np.bitwise_count(self.bitmaps[a][:, None] & self.bitmaps[b][None]).sum(2).astype(np.int64)
        most = common + np.minimum(self.slacks[a][:, None], self.slacks[b][None])
        need = self.sizes[a][:, None] + self.sizes[b][None]
        may = most * (self.den + self.num) >= self.num * need
        may &= self.known[a][:, None] != self.known[b][None]
        find = self.union.find
        for i, j in zip(*np.nonzero(may)):
            p, q = int(a[i]), int(b[j])
            if (x is y and p >= q) or find(p) == find(q):
                continue
            if self.sets is None:
                self.links.append((p, q))
                continue
            both = len(np.intersect1d(self.sets[p], self.sets[q], assume_unique=True))
            if both and self.den * both >= self.num * (len(self.sets[p]) + len(self.sets[q]) - both):
                self.union.up[find(p)] = find(q)
                self.links.append((p, q))


# -- the join -----------------------------------------------------------------


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, id) in order: each id with the hub of its run of equal sig, the run's
    first id, where a run has several ids. Rows of the partition's first run carry
    their sig instead, as the run may begin before; the first and last run are told."""
    schema, types = ["kind", "id", "hub", "sig"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(kind: int, ids: np.ndarray, hub: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.full(len(ids), kind, np.int32), ids, hub, sig), types)], names=schema)

    first = last = None  # (sig, hub)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, ids = (np.asarray(batch.column(i)) for i in (0, 1))
        if first is None:
            first = (int(sig[0]), int(ids[0]))
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
        hub = ids[start]
        if last is not None and last[0] == int(sig[0]):
            hub = np.where(start == 0, last[1], hub)
        last = (int(sig[-1]), int(hub[-1]))
        opening = sig == first[0]
        if opening.any():
            yield batch_of(1, ids[opening], hub[opening], sig[opening])
        keep = (ids != hub) & ~opening
        if keep.any():
            e = np.unique(np.stack([ids[keep], hub[keep]], axis=1), axis=0)
            h = np.unique(e[:, 1])  # a hub is in its own group
            yield batch_of(0, np.concatenate([e[:, 0], h]), np.concatenate([e[:, 1], h]), np.zeros(len(e) + len(h), np.int64))
    if first is not None:
        yield batch_of(2, np.array([first[1], last[1]]), np.array([0, 0]), np.array([first[0], last[0]]))


def groups(sigs: DataFrame) -> DataFrame:
    """From rows (sig, id) of whole numbers: (id, hub), each id with the smallest id
    that shares a signature with it, for each of its shared signatures. Ids with a
    common signature thus meet in a group. Rows are dealt out by ranges of (sig, id),
    so that a signature that very many ids share is spread over tasks; a run that
    crosses a border of two partitions gets its hub from a table of two rows a
    partition."""
    spark = sigs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = stored(sigs.repartitionByRange(n, "sig", "id").sortWithinPartitions("sig", "id").mapInArrow(_hubs, "kind int, id bigint, hub bigint, sig bigint"))
    least: dict[int, int] = {}
    for r in out.where("kind = 2").collect():  # two rows a partition
        least[r["sig"]] = min(r["id"], least.get(r["sig"], r["id"]))
    pairs = out.where("kind = 0").select("id", "hub")
    if least:
        heads = F.broadcast(spark.createDataFrame(list(least.items()), "sig bigint, head bigint"))
        pairs = pairs.union(out.where("kind = 1").join(heads, "sig").select("id", F.col("head").alias("hub")))
    return pairs.distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows of an equal leading key, one at a time."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _tree_links(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            seen: dict[tuple[int, bytes], int] = {}
            for i, c, s in rows:
                seen.setdefault((i, s), c)
            if len(seen) < 2:
                continue
            ids = [k[0] for k in seen]
            known = list(seen.values())
            tree = SignatureTree([np.frombuffer(k[1], np.uint64) for k in seen], num, den, None if known[0] is None else known)
            links = tree.join()
            if links:
                # links as stars: each linked id with the least of its component here
                least: dict[int, int] = {}
                for p in {x for pair in links for x in pair}:
                    r = tree.union.find(p)
                    least[r] = min(ids[p], least.get(r, ids[p]))
                star = [(ids[p], least[tree.union.find(p)]) for p in {x for pair in links for x in pair}]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in star], pa.int64()), pa.array([y for _, y in star], pa.int64())], names=["a", "b"])

    return run


def _open_pairs(num: int, den: int):
    """Pairs (a, b) that bitmaps leave open, from rows by family, x, y: side, id, known,
    n and bits. Members of block x, side 0, meet strays of cut y, side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            seen = sorted(set(rows))
            if len(seen) < 2:
                continue
            sides, ids, known, sizes, bits = zip(*seen)
            maps = np.frombuffer(b"".join(bits), np.uint64).reshape(len(ids), -1)
            tree = SignatureTree(None, num, den, list(known), bitmaps=maps, sizes=np.array(sizes, np.int64), sides=np.array(sides))
            links = tree.join()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([min(ids[p], ids[q]) for p, q in links], pa.int64()), pa.array([max(ids[p], ids[q]) for p, q in links], pa.int64())], names=["a", "b"])

    return run


def _exact(num: int, den: int):
    """Of rows (a, b, set of a, set of b), the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return run


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    num: int = 4,
    den: int = 5,
    block_rows: int = 4000,
    block_tokens: int = 3_000_000,
    hubs: int = 16,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of num/den
    or more: doc_id, n_shingles, component_id, one row per input row.

    1. Each set offers digests of the parts of its hash space (Levels): any two sets
       that are similar enough share one, whatever passages others have in common.
    2. Sets that share a digest, directly or through others, form a family, which is
       cut by the same size classes. Equal sets are one member.
    3. Each family is joined by a signature tree. A large family is dealt into blocks
       of bounded rows and tokens, each with the same few hubs; components follow from
       the blocks' links. Where a large family is still in several components, what
       lies outside its largest one meets every block by bitmaps, a thirtieth of the
       sets, in trees of their own; the sets of the pairs that stay open are compared. No
       pair of different components goes unchecked.

    Null and empty texts have no shingle and are linked with nothing. Rows of a null
    id form no link and have a null component. Rows with equal ids count as one
    document that has each of their sets. Ids are whole numbers; other columns are
    ignored.
    """
    levels = (num, den)
    Levels(*levels)  # checks them before any work
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lv = Levels(*levels)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n, dig, sig = [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingles(t, width)
                    n.append(len(s))
                    dig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) and i is not None else None)
                    sig.append(lv.signatures(s).view(np.int64) if i is not None else np.empty(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sig])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sig) if sig else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), lists], names=["doc_id", "n", "digest", "sigs"])
        give_back()

    spark = docs.sparkSession
    with recorded() as paths:
        rows = stored(base.mapInArrow(describe, "doc_id bigint, n bigint, digest binary, sigs array<bigint>"))
        met = groups(rows.select(F.explode("sigs").alias("sig"), F.col("doc_id").alias("id")))
        freed(spark)
        shared = components(met.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    rows = stored(rows.drop("sigs"))
    reps = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = rows.where("digest IS NOT NULL").select("digest", "doc_id").join(reps, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    in_family = reps.join(shared, reps["rep"] == shared["id"]).select("rep", F.explode(Levels(*levels).columns(F.col("n"))).alias("level"), "root", "n")
    in_family = in_family.select("rep", F.xxhash64("root", "level").alias("family"), "level", "n")
    stats = in_family.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / block_rows), F.ceil(F.col("tokens") / block_tokens)).cast("int")
    members = stored(
        in_family.join(stats.select("family", blocks.alias("blocks")), "family").select("rep", "family", "level", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")).distinct()
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = [shingles(t, width).tobytes() for t in part.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(out, pa.binary())], names=["family", "level", "blocks", "block", "id", "set"])
        give_back()

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = Levels(*levels)
        for batch in batches:
            found = [np.frombuffer(x, np.uint64) for x in batch.column(4).to_pylist()]
            bits = [bitmap(x, lv.bits(k)).tobytes() for x, k in zip(found, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (2, 3)), pa.array([len(x) for x in found], pa.int64()), pa.array(bits, pa.binary())], names=["family", "block", "id", "n", "bits"])

    # digests and families are read no more
    remove(spark, paths)
    freed(spark)
    # a shuffle join at every size, as members grow with the documents
    with_sets = (
        base.join(members.hint("merge"), base["doc_id"] == members["rep"])
        .select("family", "level", "blocks", "block", "doc_id", "text")
        .mapInArrow(sets, "family bigint, level int, blocks int, block int, id bigint, set binary")
        .where(F.octet_length("set") > 0)
    )
    large = not members.where("blocks > 1").isEmpty()
    link = lambda df: df.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(_tree_links(num, den), "a bigint, b bigint")
    none = F.lit(None).cast("bigint").alias("known")
    if not large:
        links = link(with_sets.select("family", F.col("block").alias("x"), F.lit(0).alias("y"), "id", none, "set"))
        edges = classes.union(links)
    else:
        with_sets = stored(with_sets)
        freed(spark)
        many = with_sets.where("blocks > 1")
        # a few hubs a family: of the ids that a hash picks out, about 4 * hubs, the first
        picked = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.floor(F.col("blocks") * (block_rows / (4 * hubs))))) == 0
        order = members.where("blocks > 1").where(picked).groupBy("family").agg(F.slice(F.array_sort(F.collect_set("rep")), 1, hubs).alias("hubs"))
        # broadcast, as a family has some thousand members for each of its hubs: sets don't move
        hub = many.join(F.broadcast(order.select("family", F.explode("hubs").alias("id"))), ["family", "id"]).select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.lit(0).alias("y"), "id", none, "set")
        first = stored(link(with_sets.select("family", F.col("block").alias("x"), F.lit(0).alias("y"), "id", none, "set").union(hub)))
        freed(spark)
        known = components(first)
        # beyond here, sets go as bitmaps
        marks = many.select("family", "level", "block", "id", "set").mapInArrow(bits_of, "family bigint, block int, id bigint, n bigint, bits binary")
        named = stored(marks.join(known, "id", "left").withColumn("known", F.coalesce("root", "id")).drop("root"))
        parts = stored(named.groupBy("family", "known").agg(F.count("*").alias("m")))
        main = parts.groupBy("family").agg(F.max_by("known", F.struct("m", "known")).alias("main"), F.count("*").alias("k"), (F.sum("m") - F.max("m")).alias("rest")).where("k > 1")
        cuts = F.ceil(F.col("rest") / block_rows).cast("int")
        open_ = named.join(main.select("family", "main", cuts.alias("cuts")), "family")
        stray = open_.where("known <> main").withColumn("cut", F.pmod(F.xxhash64("id", F.lit(1)), F.col("cuts")).cast("int"))
        tasks = open_.select("family", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("y"), F.lit(0).alias("side"), "id", "known", "n", "bits").union(
            stray.join(members.select("family", "blocks").distinct(), "family").select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.col("cut").alias("y"), F.lit(1).alias("side"), "id", "known", "n", "bits")
        )
        pairs = stored(tasks.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(_open_pairs(num, den), "a bigint, b bigint").distinct())
        one = many.select("id", "set").dropDuplicates(["id", "set"])
        side = lambda i, x: one.select(F.col("id").alias(i), F.col("set").alias(x)).join(pairs.select(i).distinct(), i, "left_semi")
        late = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_exact(num, den), "a bigint, b bigint")
        edges = classes.union(first).union(late)
    found = components(edges)
    freed(spark)
    return rows.select("doc_id", "n").join(found, rows["doc_id"] == found["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
