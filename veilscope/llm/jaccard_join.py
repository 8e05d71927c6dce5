"""Near duplicates by an n-gram Jaccard join over prefix trees.

Shingles are ordered globally, rare ones first by a frequency sketch of fixed size, then by hash; any order gives the
same links, this one keeps shared passages out of the prefixes. Documents with equal sets are one class. Two sets that
link share a shingle among the first n - ceil(0.8 n) + 1 of each, so that classes meet where such a shingle is equal. A
shingle in very many prefixes is salted: its members are dealt to blocks, and blocks meet in pairs.

A meeting of g sets does not give g * g pairs. First each set meets one leader; links that hold make components. Only
pairs that are then still in different components are tried, all of them, so that no link is lost. Before any text moves
a pair is weighed by its sets' parities: one bit for each place, set where an odd number of shingles fall. Parities that
differ in more places than linked sets may differ in shingles rule a link out; about one bit a shingle rules out nearly
all pairs that share a passage only.

What is left tells where to look: sets go to shards by their first shingle in the order, so that near copies
lie together, and a shard's sets are stored in path-compressed tries. A set that has a partner in a shard probes all of
it. One walk serves many probes: it visits a node once, counts the overlap of the node's run with every probe that is
still alive, and lets a probe go for all sets below as soon as its overlap so far plus what can remain is too small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORDS, PERCENT = 5, 80
#: Bytes of text whose shingles are made at a time, which take many times that.
PIECE = 1_000_000
#: Counters of the frequency sketch, 1 byte each when broadcast, and counters in a row while it is summed.
SKETCH, CHUNK = 1 << 22, 1 << 16
#: Prefix entries for each shard of meetings; shingles in a shard of tries.
SHARD_ENTRIES, TRIE_SHINGLES = 1_000_000, 1_000_000
#: Members of a block of a salted shingle; the most shingles that are salted, which bounds what is broadcast; and the count
#: in a sample of documents that marks one. The sample only deals work: without it the links are the same.
BLOCK, HOT, SEEN = 1024, 1_000_000, 32
#: Meetings of at most so many are cut to the sets that may link with another by their reaches before they are written.
NEAR = 16
#: Bits of the map that tells most documents without a try from the others before their sets are made; a join by id is exact.
PLACES = 1 << 23
#: The fewest places of a set's parities.
LEAST = 64


def shingles(texts: list[bytes], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of all texts, text by text and by hash inside, and how many each text has."""
    codes, counts, distinct = common.coded(texts)
    n = len(texts)
    h = common.hashed(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    ends = np.cumsum(counts)
    rows = np.repeat(np.arange(n), counts)
    left = np.repeat(ends, counts) - np.arange(len(codes))  # words from here to the text's end
    total = np.full(len(codes), np.uint64(k))
    for i in range(k):
        total = common.mixed(total * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([h[i:], np.zeros(min(i, len(h)), np.uint64)]))
    own = left >= k
    values, rows = [total[own]], [rows[own]]
    for t in np.flatnonzero((counts > 0) & (counts < k)):  # the whole sequence is the one shingle
        x = np.array([counts[t]], np.uint64)
        for w in h[ends[t] - counts[t] : ends[t]]:
            x = common.mixed(x * np.uint64(0x9E3779B97F4A7C15) + w)
        values.append(x)
        rows.append(np.array([t]))
    values, rows = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[first], np.bincount(rows[first], minlength=n)


def sketch(spark: SparkSession, texts: DataFrame, size: int = SKETCH) -> np.ndarray:
    """log2 of how many sets hold the shingles of each counter, from all texts. Its size does not depend on the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for _, t in common.pieces(batches, most=PIECE):
            at, n = np.unique(shingles(t)[0] % np.uint64(size), return_counts=True)
            total[at] += n.astype(np.uint32)
        for c in range(0, size, CHUNK):
            if (part := total[c : c + CHUNK]).any():  # byte by byte of the counters, which are mostly small
                blob = zstandard.compress(part.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "n"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(min(CHUNK, size), np.uint64)
        for blob in group.column("n").to_pylist():
            total += np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})

    parts = texts.mapInArrow(common.lean(run), "chunk int, n binary").groupBy("chunk").applyInArrow(add, "chunk int, level binary")
    out = np.zeros(size, np.uint8)
    for r in parts.toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["level"], np.uint8)
    return out


def ordered(values: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of each text in the global order."""
    return values[np.lexsort((values, levels[(values % np.uint64(len(levels))).astype(np.int64)], np.repeat(np.arange(len(counts)), counts)))]


def needed(a: np.ndarray, b: int, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of sets of these sizes that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def parities(values: np.ndarray) -> bytes:
    """A bit for each place of a power of two, at least as many as shingles: whether an odd number of them fall there."""
    places = max(LEAST, 1 << (len(values) - 1).bit_length() if len(values) else 0)
    return np.packbits(np.bincount((values & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has, from their parities."""
    while len(x) != len(y):  # twice the places: the halves fall together
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


class Trie:
    """Sets in the global order, sorted, with the runs that neighbours share stored and walked once."""

    def __init__(self, sets: list[np.ndarray], names: list[int], keys: list[bytes]):
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets, self.names = [sets[i] for i in order], [names[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        shared = [0]  # what a set shares with the one before it
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            same = a[:n] == b[:n]
            shared.append(n if same.all() else int(same.argmin()))
        self.shared, self.walked = np.array(shared), 0  # walked: shingles of all runs visited so far

    def linked(self, probes: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
        """(place of a probe, name of a set) of all links, by one walk for all probes."""
        sizes = np.array([len(p) for p in probes])
        flat, owner = np.concatenate(probes), np.repeat(np.arange(len(probes)), sizes)
        order = np.argsort(flat, kind="stable")
        values, starts = np.unique(flat[order], return_index=True)
        owner, starts = owner[order], np.append(starts, len(flat))
        found: list[tuple[int, int]] = []
        stack = [(0, len(self.sets), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            lo, hi, depth, alive, overlap = stack.pop()  # sets lo to hi share `depth` shingles, of which a probe has `overlap`
            end = int(self.shared[lo + 1 : hi].min()) if hi - lo > 1 else int(self.sizes[lo])
            run = self.sets[lo][depth:end]  # the node's run, common to all
            self.walked += len(run)
            at = np.searchsorted(values, run)
            inside = at < len(values)
            inside[inside] = values[at[inside]] == run[inside]
            at = at[inside]
            if len(at):
                times = starts[at + 1] - starts[at]
                places = np.repeat(starts[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
                overlap = overlap + np.bincount(owner[places], minlength=len(probes))[alive]
            least, most, own = int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), sizes[alive]
            keep = overlap + np.minimum(most - end, own - overlap) >= needed(own, least, percent)
            alive, overlap = alive[keep], overlap[keep]
            if not len(alive):
                continue
            if hi - lo == 1:  # nothing remains: what was kept has the overlap
                found += [(int(p), self.names[lo]) for p in alive]
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(self.shared[lo + 1 : hi] == end)).tolist(), hi]
            stack += [(a, b, end, alive, overlap) for a, b in zip(cuts, cuts[1:], strict=False)]
        return found


class Forest:
    """Which names are tied together so far. A link inside a tree says nothing new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def tie(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. links: a, b.

    Alternating large-star and small-star: every id is tied to the smallest of its neighbours until nothing changes.
    Each round is written in the shared folder; hubs cost one row a link, and the join of a hub can be split.
    """
    edges, path = common.saved_at(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, between = common.saved_at(spark, large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        small, after = common.saved_at(spark, small, "edges")
        left, right = (x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() for x in (edges, small))
        for old in (path, between):
            common.drop(spark, old)
        edges, path = small, after
        if left == right:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


class Join:
    """The steps of the join over one table of documents."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, percent: int):
        self.spark, self.percent = df.sparkSession, percent
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.levels = self.spark.sparkContext.broadcast(sketch(self.spark, self.docs.select("text")))  # SKETCH bytes

    def sets(self) -> DataFrame:
        """id, n, digest and parities of the set, home (its first shingle) and prefix in the global order, one row for each
        document; written once.
        """
        levels, percent = self.levels, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in common.pieces(batches, most=PIECE):
                values, counts = shingles(texts)
                edges, sorted_ = common.bounds(counts), ordered(values, counts, levels.value)
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edges, edges[1:], strict=False)]
                signs = [parities(values[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                prefixes = [sorted_[a : a + n - -(-percent * n // 100) + 1 if n else a].tobytes() for a, n in zip(edges[:-1], counts, strict=True)]
                home = np.append(sorted_, np.uint64(0)).view(np.int64)[edges[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(home), pa.array(prefixes, pa.binary())], ["id", "n", "digest", "parities", "home", "prefix"])

        return common.saved(self.spark, self.docs.mapInArrow(common.lean(run), "id long, n long, digest binary, parities binary, home long, prefix binary"), "sets")

    def hot(self, classes: DataFrame, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles in the prefixes of very many sets, and the blocks that their members are dealt to, by a sample of sets."""
        least = max(BLOCK, entries // HOT)
        every = max(1, least // SEEN)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8"))], ["shingle"])

        some = classes.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("prefix").mapInArrow(common.lean(run), "shingle long")
        rows = some.groupBy("shingle").count().filter(F.col("count") >= SEEN).orderBy("shingle").collect()  # at most HOT, about
        blocks = np.array([-(-r["count"] * every // BLOCK) for r in rows], np.int64)
        values = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(values)
        return values[order], blocks[order]

    def meetings(self, classes: DataFrame, entries: int) -> DataFrame:
        """shingle, block, blocks, members (n, id, reach by size): where at least two classes meet by a shingle of their prefixes.

        entries is the number of prefix shingles, or more; the number of shards follows from it.

        reach is the number of shingles from the one at hand to the set's last. The first common shingle of two sets
        that link has at least the needed overlap in reach of both, so that pairs with less in reach are left to others.
        """
        percent = self.percent
        shards = max(common.partitions(self.spark), int(entries // SHARD_ENTRIES) + 1)
        salted = self.spark.sparkContext.broadcast(self.hot(classes, entries))  # at most HOT shingles

        def dealt_to(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The block of each entry, and how many its shingle has."""
            blocks = np.ones(len(values), np.int64)
            hot, of = salted.value
            if len(hot):
                at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
                blocks = np.where(hot[at] == values, of[at], 1)
            return (common.mixed(ids.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64), blocks

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sent = batch.column(2).to_pylist()
                values = np.frombuffer(b"".join(sent), "<u8")
                times = np.array([len(b) // 8 for b in sent], np.int64)
                ids, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1))
                reach = n - (np.arange(len(values)) - np.repeat(np.cumsum(times) - times, times))
                shard = (common.mixed(values + dealt_to(values, ids)[0].astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]])) if len(order) else np.array([0])
                cut = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[order][edges[:-1]], pa.int32()), *(pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (values, ids, n, reach))], ["shard", "values", "ids", "sizes", "reaches"])

        def meet(key: tuple, group: pa.Table) -> pa.Table:
            values, ids, sizes, reaches = (np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in (("values", "<u8"), ("ids", "<i8"), ("sizes", "<i8"), ("reaches", "<i8")))
            block, blocks = dealt_to(values, ids)
            order = np.lexsort((ids, sizes, block, values))
            values, ids, sizes, reaches, block, blocks = (x[order] for x in (values, ids, sizes, reaches, block, blocks))

            def borders(v: np.ndarray, b: np.ndarray) -> np.ndarray:
                return np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (b[1:] != b[:-1]), [True]])) if len(v) else np.zeros(1, np.int64)

            times = np.diff(borders(values, block))
            live = np.repeat(times > NEAR, times) | (blocks > 1)  # smaller meetings keep who may link with another
            for d in range(1, NEAR):
                ok = (values[d:] == values[:-d]) & (np.minimum(reaches[d:], reaches[:-d]) >= needed(sizes[d:], sizes[:-d], percent))
                live[d:] |= ok
                live[:-d] |= ok
            values, ids, sizes, reaches, block, blocks = (x[live] for x in (values, ids, sizes, reaches, block, blocks))
            edges = borders(values, block)
            several = (np.diff(edges) > 1) | (blocks[edges[:-1]] > 1)
            inside = np.repeat(several, np.diff(edges))
            offsets = np.concatenate([[0], np.cumsum(np.diff(edges)[several])]).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x[inside]) for x in (sizes, ids, reaches)], ["n", "id", "reach"]))
            one = edges[:-1][several]
            return pa.table({"shingle": pa.array(values[one].view(np.int64)), "block": pa.array(block[one]), "blocks": pa.array(blocks[one]), "members": members})

        dealt = classes.select("id", "n", "prefix").mapInArrow(common.lean(deal), "shard int, values binary, ids binary, sizes binary, reaches binary")
        met = dealt.groupBy("shard").applyInArrow(meet, "shingle long, block long, blocks long, members array<struct<n:long,id:long,reach:long>>")
        return common.saved(self.spark, met, "meetings")

    def stars(self, meetings: DataFrame) -> DataFrame:
        """Pairs (a, b) of a meeting's leader and its members that may link.

        The leader is the set that meets most often: an original meets its copies by every rare shingle that they keep,
        while the copies meet by fewer.
        """
        rows = meetings.select("shingle", "block", "blocks", F.explode("members").alias("m")).select("shingle", "block", "blocks", "m.*")
        often = rows.groupBy("id").agg(F.count("*").alias("often"))
        rows = rows.join(often, "id")
        leaders = rows.groupBy("shingle", "blocks").agg(F.max(F.struct("often", F.bitwise_not("id").alias("first"), "n", "reach")).alias("a"))
        pairs = rows.drop("blocks").join(in_blocks(leaders), ["shingle", "block"]).filter(f"least(reach, a.reach) * {100 + self.percent} >= (n + a.n) * {self.percent}")
        return pairs.select(F.bitwise_not("a.first").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()

    def rest(self, meetings: DataFrame, parts: DataFrame) -> DataFrame:
        """All pairs (a, b) that meet, may link by sizes and reaches, and are in different components so far."""
        percent = self.percent
        rows = meetings.select("shingle", "block", "blocks", F.explode("members").alias("m")).select("shingle", "block", "blocks", "m.*")
        rows = rows.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = rows.groupBy("shingle", "blocks").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("shingle", "blocks")
        rows = rows.drop("blocks").join(in_blocks(mixed), ["shingle", "block"])
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.select("*", other.alias("other")).select("shingle", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("long").alias("side"), "n", "reach", "component", "id")
        rows = rows.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y", "side", "n", "id")

        def between(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[np.ndarray]:
            """x and y: rows of n, reach, component, id, by n. Pairs by blocks of rows."""
            for i in range(0, len(x), 1024):
                a = x[i : i + 1024]
                lo, hi = np.searchsorted(y[:, 0], [-(-percent * a[0, 0] // 100), 100 * a[-1, 0] // percent + 1])
                for j in range(max(lo, i if same else 0), hi, 4096):
                    b = y[j : min(j + 4096, hi)]
                    ok = (np.minimum(a[:, 1, None], b[:, 1]) >= needed(a[:, 0, None], b[:, 0], percent)) & (a[:, 2, None] != b[:, 2])
                    if same:
                        ok &= i + np.arange(len(a))[:, None] < j + np.arange(len(b))
                    p, q = np.nonzero(ok)
                    yield np.sort(np.column_stack([a[p, 3], b[q, 3]]), axis=1)

        def met(rows: np.ndarray) -> Iterator[np.ndarray]:
            same = rows[0, 1] == rows[0, 2]
            x, y = (rows[:, 4:], rows[:, 4:]) if same else (rows[rows[:, 3] == k][:, 4:] for k in (0, 1))
            return between(x, y, same)

        def meetings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            """Ordered rows by meeting of one block or two, which is all that is held."""
            held: list[np.ndarray] = []
            for batch in batches:
                own = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                edges = np.flatnonzero(np.concatenate([[True], (own[1:, :3] != own[:-1, :3]).any(1), [True]])) if len(own) else []
                for a, b in zip(edges, edges[1:], strict=False):
                    if held and (held[-1][-1, :3] != own[a, :3]).any():
                        yield np.concatenate(held)
                        held = []
                    held.append(own[a:b])
            if held:
                yield np.concatenate(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, n = [np.empty((0, 2), np.int64)], 0
            for rows in meetings_of(batches):
                for both in met(rows):
                    out.append(both)
                    n += len(both)
                    if n > 1 << 16:
                        yield sent(np.concatenate(out))
                        out, n = out[:1], 0
            yield sent(np.concatenate(out))

        def sent(both: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in (0, 1)], ["a", "b"])

        return rows.mapInArrow(common.lean(run), "a long, b long").distinct()

    def possible(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and parities allow a link; written once. sets: id, n, parities; rows that repeat an id give one pair."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                most = n + m - 2 * needed(n, m, percent)  # shingles of one side only
                far = np.fromiter(map(apart, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, len(a))
                yield pa.RecordBatch.from_arrays([pa.array(x[far <= most]) for x in (a, b)], ["a", "b"])

        def side(name: str, *columns: str) -> DataFrame:
            return sets.select("id", "n", "parities").toDF(name, *columns)

        rows = pairs.join(side("a", "n", "p"), "a").join(side("b", "m", "q"), "b").select("a", "b", "n", "m", "p", "q")
        return common.saved(self.spark, rows.mapInArrow(common.lean(run), "a long, b long").distinct(), "possible")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links that tie together all that the pairs' links tie; written once. pairs: a, the probe, and b, the stored set.

        The sets b are stored in shards by home; no shard has more than TRIE_SHINGLES, but for its last set. A probe goes to
        each shard that has a partner of it. Texts move compressed, a third of their sets' size, and become sets where
        they are tried. Of the links of a shard those are written that tie something new.
        """
        levels, percent = self.levels, self.percent
        stored = pairs.select(F.col("b").alias("id")).distinct().join(sets.select("id", "n", "home").dropDuplicates(["id"]), "id")
        total = stored.agg(F.sum("n")).first()[0] or 0
        stored = stored.withColumn("bucket", F.pmod(F.xxhash64("home"), F.lit(int(total // TRIE_SHINGLES) + 1)))
        before = F.sum("n").over(Window.partitionBy("bucket").orderBy("home", "id").rowsBetween(Window.unboundedPreceding, -1))
        stored = stored.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / TRIE_SHINGLES).cast("long"))
        stored = common.saved(self.spark, stored.select("id", "bucket", "part"), "stored")
        probes = pairs.join(stored.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "bucket", "part").distinct()
        roles = stored.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True)))
        roles = common.saved(self.spark, roles, "roles")
        place = (F.pmod(F.xxhash64("id"), F.lit(PLACES)) + 1).alias("place")
        bits = roles.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        texts = self.docs.select("id", "text", place).withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(bits), "bucket")
        bit = F.bitmap_bit_position("place").cast("int")
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(place) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        texts = texts.filter(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).select("id", "text")

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compress = zstandard.ZstdCompressor(3).compress
            for batch, t in common.pieces(batches, most=PIECE):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(compress, t)), pa.binary())], ["id", "blob"])

        def opened(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
            """(bucket, part, probe, id) of some rows, their shingles, and how many each has; for a few MB of text at a time."""
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            decompress = zstandard.ZstdDecompressor().decompress
            at = size = 0
            texts: list[bytes] = []
            for x in [*batch.column(4), None]:
                if texts and (x is None or size > common.CHUNK_BYTES):
                    yield rows[at : at + len(texts)], *shingles(texts)
                    at, size, texts = at + len(texts), 0, []
                if x is not None:
                    texts.append(decompress(x.as_py()))
                    size += len(texts[-1])

        def trie(parts: list[tuple[list[int], np.ndarray, np.ndarray]]) -> Trie:
            ids, values, counts = [i for p in parts for i in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            edges, flat = common.bounds(counts), ordered(values, counts, levels.value)
            key_bytes = np.empty((len(flat), 9), np.uint8)  # they compare as the global order does
            key_bytes[:, 0] = levels.value[(flat % np.uint64(len(levels.value))).astype(np.int64)]
            key_bytes[:, 1:] = flat.astype(">u8").view(np.uint8).reshape(-1, 8)
            cuts = list(zip(edges, edges[1:], strict=False))
            return Trie([flat[x:y] for x, y in cuts], ids, [key_bytes[x:y].tobytes() for x, y in cuts])

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by shard, the stored sets first, then the probes, which are walked some at a time."""
            key, parts, tree, forest = None, [], None, Forest()
            for batch in batches:
                for rows, values, counts in opened(batch):
                    edges = common.bounds(counts)
                    cuts = [0, *(k for k in range(1, len(rows)) if rows[k][:3] != rows[k - 1][:3]), len(rows)]
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        ids, own, n = [r[3] for r in rows[x:y]], values[edges[x] : edges[y]], counts[x:y]
                        if rows[x][:2] != key:
                            key, parts, tree, forest = rows[x][:2], [], None, Forest()
                        if not rows[x][2]:
                            parts.append((ids, own, n))
                            continue
                        if tree is None:
                            tree, parts = trie(parts), []
                        inner = common.bounds(n)
                        found = tree.linked([own[i:j] for i, j in zip(inner, inner[1:], strict=False)], percent)
                        new = [(ids[p], i) for p, i in found if ids[p] != i and forest.tie(ids[p], i)]
                        yield pa.RecordBatch.from_arrays([pa.array([l[k] for l in new], pa.int64()) for k in (0, 1)], ["a", "b"])

        rows = roles.join(texts.mapInArrow(common.lean(small), "id long, blob binary"), "id")
        rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "probe", "id").select("bucket", "part", "probe", "id", "blob")
        return common.saved(self.spark, rows.mapInArrow(common.lean(check), "a long, b long"), "links")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows with `blocks`, once for each block."""
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id (the smallest id that links reach), class_id.

    class_id is the smallest id with the same set. Null, empty and blank texts have no shingle and are alone; fewer than
    WORDS words are one shingle. The id is a whole number and the key: rows that repeat an id must repeat its text, and
    share a component. A null id keeps a null component. Other columns are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    join = Join(df, id_col, text_col, percent)
    sets = join.sets()
    some = sets.filter("n > 0")
    names = common.saved(spark, some.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("class_id")), "classes")
    classes = sets.join(names.select(F.col("class_id").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    entries = sets.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1"))).first()[0] or 0
    meetings = join.meetings(classes, int(entries))
    links = join.verified(join.possible(join.stars(meetings), sets), sets)
    parts = components(spark, links)
    found = join.verified(join.possible(join.rest(meetings, parts), sets), sets)
    if found.limit(1).count():
        parts = components(spark, parts.toDF("a", "b").union(found))
    out = some.select("id", "n", "digest").join(names, "digest", "left").select("id", "n", "class_id")
    out = out.join(parts.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("id", "n", "class_id", "component")
    none = sets.filter("n = 0").select("id", "n", F.col("id").alias("class_id"), F.lit(None).cast("long").alias("component"))
    out = out.withColumn("class_id", F.when(F.col("id").isNotNull(), F.col("class_id"))).union(none)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "class_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "class_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one whose doc_id and text hash lowest, with all columns.

    The hash is the key of the join, so that ids may be null, or repeat with other texts. Rows equal in both share a
    fate; after exact deduplication there are none.
    """
    common.tune(spark)
    key = next(f"near_key_{k}" for k in range(len(docs.columns) + 1) if f"near_key_{k}" not in docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    gone = jaccard_components(keyed, key).filter(F.col(key) != F.col("component_id")).select(key)
    return keyed.join(gone, key, "left_anti").drop(key).select(docs.columns)


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
SQL: dict[str, str] = {}
