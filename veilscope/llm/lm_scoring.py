"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

The first level holds the words, in the order of their hashes, with the running sum of their counts; a word's id is its
rank. The second and third levels hold the successors of words and of pairs. They are cut into shards of about equal
numbers of tokens: the sum of the counts before a context, plus the successor's share of the context's own count, gives a
place that rises with (context, successor), so that a frequent context is split among as many shards as it fills. Each
shard is a file in the shared folder that workers map into memory. For each level it holds a rising Elias-Fano
sequence of (context, successor), whose high bits are the monotone pointers to a context's children, and a quantised
probability for each. An n-gram is looked up by successor search below its context.

Levels are interpolated: p(w|c) = (1 - x) n(c,w) / n(c) + x p(w|shorter c). The weight x depends on how often the
context was seen only. It is the share of tokens that would be new after such a context, by leaving each training token out once:
whole numbers summed over all shards, so that nothing depends on how the work is cut. A stored probability is (1 - x)
n(c,w) / n(c); lookup adds the share of the shorter context, which it has at hand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, elias_fano

#: Tokens of each shard of the second and third level; distinct words that a map task gathers before it sends them.
SHARD_TOKENS, GATHERED = 2_000_000, 1_500_000
#: Characters for one shard of words; shards grow with the square root of the text, faster than a vocabulary's shards fill.
WORD_CHARS = 4_000_000
#: Codes for each decade of a probability, in two bytes: 16 decades.
STEP = 4096
#: Bands of how often a context was seen: one for each number up to 8, then one for each power of two.
BANDS = 70
#: Ids of words are 32-bit numbers.
MOST_TYPES = (1 << 32) - 2
#: Stands for the end of a text, and as a context for its beginning.
END = np.uint64(0)


def hashes(distinct: list[bytes]) -> np.ndarray:
    h = common.hashed(distinct)
    return np.where(h == END, np.uint64(1), h)


def band(n: np.ndarray) -> np.ndarray:
    """The band of a context seen n times, n >= 1."""
    n = np.maximum(n, 1)
    return np.where(n <= 8, n - 1, 5 + np.log2(n).astype(np.int64)).astype(np.int64)


def coded(p: np.ndarray) -> np.ndarray:
    """Quantised probabilities."""
    return np.minimum(np.rint(np.log10(p) * -STEP), 65535).astype(np.uint16)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    k, n = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (keys, counts))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], (np.add.reduceat(n, first) if len(k) else n)


def planes(x: np.ndarray, kind: str) -> bytes:
    """The bytes of numbers, first bytes first, which compress better so."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def packed(*columns: tuple[np.ndarray, str]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join([np.array([len(x) for x, _ in columns], "<i8").tobytes(), *[planes(x, k) for x, k in columns]]))


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(data, "<i8", len(kinds)), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += int(n) * width
    return out


def rising(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which np.cumsum undoes."""
    return np.diff(x, prepend=x[:0].sum(dtype=x.dtype))


class Gatherer:
    """Counts of hashed words in a map task, sent as one blob for each shard when there are many."""

    def __init__(self, shards: int):
        self.shards, self.keys, self.counts, self.n = shards, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        if self.n > GATHERED:
            yield from self.sent()

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            k, n = merged(self.keys, self.counts)
            self.keys, self.counts, self.n = [], [], 0
            yield blobs(word_shard(k, self.shards), lambda a, b: packed((rising(k[a:b]), "<u8"), (n[a:b], "<i8")))


def blobs(shard: np.ndarray, of) -> pa.RecordBatch:
    """A row for each run of one shard; of(a, b) packs what lies from a to b."""
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int64)), pa.array([of(a, b) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["shard", "blob"])


def runs(x: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The values of an ordered array and where they lie."""
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else []
    return ((int(x[a]), slice(a, b)) for a, b in zip(edges, edges[1:], strict=False))


class Trie:
    """The levels of a model, as a worker sees them. words: (types, tokens) of each shard of the first level, in order.

    weights: for the second and third level, the weight of the shorter context by band.
    """

    def __init__(self, folder: str, words: tuple[tuple[int, int], ...], shard_tokens: int, weights: tuple[tuple[float, ...], ...] = ()):
        self.folder, self.word_shards, self.shard_tokens = folder, len(words), shard_tokens
        self.first, self.sums = (np.concatenate([[0], np.cumsum([w[i] for w in words])]).astype(np.int64) for i in (0, 1))
        self.types, self.tokens = int(self.first[-1]), int(self.sums[-1])
        self.below = self.tokens + 0.5 * (self.types + 1)
        self.shards = -(-self.tokens // shard_tokens)
        self.weights = np.array(weights).reshape(-1, BANDS)

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown), counts, and sums of the counts before, of hashed words."""
        ids, counts, before = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = word_shard(h, self.word_shards)
        order = np.argsort(shard, kind="stable")
        for s, own in runs(shard[order]):
            if self.first[s + 1] > self.first[s]:
                at = order[own]
                arrays = elias_fano.mapped(self.folder, f"words-{s}")
                place, found = elias_fano.Sequence(arrays).successors(h[at] - first_hash(s, self.word_shards))
                at, place = at[found], place[found]
                ids[at] = self.first[s] + place
                sums = arrays["sums"]
                counts[at], before[at] = sums[place + 1] - sums[place], self.sums[s] + sums[place]
        return ids, counts, before

    def counted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, and sums of the counts before, of ordered known ids."""
        counts, before = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        for s, own in runs(np.searchsorted(self.first, ids, side="right") - 1):
            sums, place = elias_fano.mapped(self.folder, f"words-{s}")["sums"], ids[own] - self.first[s]
            counts[own], before[own] = sums[place + 1] - sums[place], self.sums[s] + sums[place]
        return counts, before

    def shard(self, count: np.ndarray, before: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Where the pairs of a context, seen `count` times, lie; it rises with (context, successor)."""
        inside = np.minimum((count * (successor / max(1, self.types))).astype(np.int64), count - 1)
        return (before + inside) // self.shard_tokens

    def pairs(self, context: np.ndarray, count: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of ids: stored probability (0: not seen), band as a context, shard, and place in it (-1: not seen)."""
        p, bands, place = np.zeros(len(word)), np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        shard = np.full(len(word), -1, np.int64)
        shard[known] = self.shard(count[known], before[known], word[known])
        known = known[np.argsort(shard[known], kind="stable")]
        for s, own in runs(shard[known]):
            at = known[own]
            arrays = elias_fano.mapped(self.folder, f"levels-{s}")
            if arrays is None:
                continue
            first, last = arrays["contexts"]
            at = at[(context[at] >= first) & (context[at] <= last)]
            where, found = elias_fano.Sequence(arrays, "pair_").successors((context[at] - first) * self.types + word[at])
            at, where = at[found], where[found]
            place[at], bands[at] = where, arrays["bands"][where]
            p[at] = 10 ** (elias_fano.mapped(self.folder, f"codes-{s}")["pairs"][where] / -STEP)
        return p, bands, shard, place

    def triples(self, shard: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Stored probabilities of words after pairs that lie at these places; 0 where not seen."""
        p = np.zeros(len(word))
        known = np.flatnonzero((place >= 0) & (word >= 0))
        known = known[np.argsort(shard[known], kind="stable")]
        for s, own in runs(shard[known]):
            at = known[own]
            where, found = elias_fano.Sequence(elias_fano.mapped(self.folder, f"levels-{s}"), "triple_").successors(place[at] * self.types + word[at])
            p[at[found]] = 10 ** (elias_fano.mapped(self.folder, f"codes-{s}")["triples"][where[found]] / -STEP)
        return p


def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of equal width, by the upper half of a hash."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def first_hash(shard: int, shards: int) -> np.uint64:
    return np.uint64(-(-(shard << 32) // shards) << 32)


@lru_cache(4)
def trie(*model) -> Trie:
    return Trie(*model)


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens with an end after each text, tokens of each text, and the hash that each code stands for."""
    codes, counts, distinct = common.coded(texts)
    tokens = np.insert(codes + 1, common.bounds(counts)[1:], 0)
    return tokens, counts + 1, np.concatenate([[END], hashes(distinct)]).astype(np.uint64)


class Read:
    """The tokens of some texts as a trie knows them, with codes in the order of ids: code, and for each code id, count
    and the sum of the counts before. Every token is the second of a pair; its first is the end of the text before, at
    the beginning of a text. `inner` are the tokens that another one of their text follows.
    """

    def __init__(self, t: Trie, texts: list[bytes]):
        tokens, self.counts, names = stream(texts)
        ids, count, before = t.words(names)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.tokens, self.ids, self.count, self.before, self.n = rank[tokens], ids[order], count[order], before[order], len(order)
        first = np.concatenate([rank[:1], self.tokens[:-1]])
        self.pairs, self.pair = np.unique(first * self.n + self.tokens, return_inverse=True)
        self.inner = np.flatnonzero(tokens != 0)


def word_shards(docs: DataFrame, text_col: str) -> int:
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(1, int((chars / WORD_CHARS) ** 0.5) + 1)


def learn(docs: DataFrame, text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> tuple:
    """What Trie takes, from all texts of docs. The driver gets two numbers for each shard of words and two for each band.

    Pass 1 counts words by hash, pass 2 counts triples of ids, from which the shards sum their pairs. A map task sends sums
    of what it has seen. All successors of a pair lie in one shard, one entry each for a task and a word. Null texts count
    as empty: one end. More words than a 32-bit number can tell apart raise an error.
    """
    spark = docs.sparkSession
    folder = f"{common.scratch_root(spark)}/trie-{uuid.uuid4().hex[:8]}"
    texts = docs.select(F.col(text_col).alias("text"))
    many = word_shards(docs, text_col)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Gatherer(many)
        for _, t in common.pieces(batches):
            tokens, _, names = stream(t)
            yield from own.add(names, np.bincount(tokens, minlength=len(names)))
        yield from own.sent()

    def build_words(key: tuple, group: pa.Table) -> pa.Table:
        s = key[0].as_py()
        parts = [unpacked(b, "<u8", "<i8") for b in group.column("blob").to_pylist()]
        k, n = merged([np.cumsum(p[0], dtype=np.uint64) for p in parts], [p[1] for p in parts])
        start = first_hash(s, many)
        end = int(first_hash(s + 1, many)) if s + 1 < many else 1 << 64
        elias_fano.write(folder, f"words-{s}", elias_fano.encode(k - start, end - int(start)) | {"sums": common.bounds(n)})
        return pa.table({"shard": pa.array([s], pa.int64()), "types": pa.array([len(k)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    sent = texts.mapInArrow(count_words, "shard long, blob binary")
    built = sent.groupBy("shard").applyInArrow(build_words, "shard long, types long, tokens long").collect()  # a row a shard
    sizes = {r["shard"]: (r["types"], r["tokens"]) for r in built}
    words = tuple(sizes.get(s, (0, 0)) for s in range(many))
    model = (folder, words, shard_tokens)
    if sum(w[0] for w in words) > MOST_TYPES:
        raise ValueError("more distinct words than 32-bit ids can tell apart")
    if not sizes:
        return model
    del sent
    common.collected(spark)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(*model)
        for _, x in common.pieces(batches):
            r = Read(t, x)
            after = np.full(len(r.tokens), r.n, np.int64)  # nothing follows an end
            after[r.inner] = r.tokens[r.inner + 1]
            own, n = np.unique(r.pair * (r.n + 1) + after, return_counts=True)
            pair, word = own // (r.n + 1), own % (r.n + 1)
            edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))  # each pair has a successor here
            u, v = r.pairs // r.n, r.pairs % r.n
            key = r.ids[u].astype(np.uint64) * np.uint64(t.types) + r.ids[v].astype(np.uint64)
            word = np.append(r.ids, t.types)[word]
            children = np.diff(edges)
            yield blobs(t.shard(r.count[u], r.before[u], r.ids[v]), lambda a, b, k=key, c=children, e=edges, w=word, m=n: packed((rising(k[a:b]), "<u8"), (c[a:b], "<u4"), (w[e[a] : e[b]], "<u4"), (m[e[a] : e[b]], "<u4")))

    def build_levels(key: tuple, group: pa.Table) -> pa.Table:
        s, t = key[0].as_py(), trie(*model)
        parts = [unpacked(b, "<u8", "<u4", "<u4", "<u4") for b in group.column("blob").to_pylist()]
        sent, children = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts])
        keys, at = np.unique(sent, return_inverse=True)
        k, n = merged([np.repeat(at, children) * (t.types + 1) + np.concatenate([p[2] for p in parts]).astype(np.int64)], [np.concatenate([p[3] for p in parts])])
        of, word = k // (t.types + 1), k % (t.types + 1)
        total = np.bincount(of, n, len(keys)).astype(np.int64)  # exact below 2 ** 53
        context = (keys // np.uint64(t.types)).astype(np.int64)
        seen = t.counted(context)[0]
        first, last = int(context[0]), int(context[-1])
        followed = word < t.types
        of, word, n = of[followed], word[followed], n[followed]
        arrays = {"contexts": np.array([first, last], np.int64), "bands": band(total).astype(np.uint8)}
        arrays |= {f"pair_{x}": y for x, y in elias_fano.encode(keys - np.uint64(first * t.types), (last - first + 1) * t.types).items()}
        arrays |= {f"triple_{x}": y for x, y in elias_fano.encode(of * t.types + word, len(keys) * t.types).items()}
        elias_fano.write(folder, f"levels-{s}", arrays)
        shares = {"pairs": coded(total / seen), "of": band(seen).astype(np.uint8), "triples": coded(n / total[of]), "children": np.bincount(of, minlength=len(keys)).astype(np.uint32)}
        elias_fano.write(folder, f"shares-{s}", shares)
        out = []
        for level, count, whole in ((0, total, seen), (1, n, total[of])):
            own = whole > 1  # what is left of the context without the token at hand
            bands = band(whole[own] - 1)
            tokens, fresh = (np.bincount(bands, x, BANDS).astype(np.int64) for x in (count[own], count[own] == 1))
            out += [(s, level, b, int(tokens[b]), int(fresh[b])) for b in np.flatnonzero(tokens)]
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("shard", "level", "band", "tokens", "fresh"))})

    sent = texts.mapInArrow(count_triples, "shard long, blob binary")
    built = sent.groupBy("shard").applyInArrow(build_levels, "shard long, level long, band long, tokens long, fresh long")
    sums = {(r["level"], r["band"]): (r["tokens"], r["fresh"]) for r in built.groupBy("level", "band").agg(F.sum("tokens").alias("tokens"), F.sum("fresh").alias("fresh")).collect()}  # two levels of BANDS
    weights = tuple(weighed([sums.get((level, b), (0, 0)) for b in range(BANDS)]) for level in (0, 1))
    model = (*model, weights)
    del sent, built
    common.collected(spark)

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                shares = elias_fano.mapped.__wrapped__(folder, f"shares-{s}")
                if shares is not None:
                    more = coded(1 - np.array(weights)).astype(np.int64)
                    under = np.repeat(elias_fano.mapped.__wrapped__(folder, f"levels-{s}")["bands"], shares["children"])
                    codes = {"pairs": shares["pairs"] + more[0][shares["of"]], "triples": shares["triples"] + more[1][under]}
                    elias_fano.write(folder, f"codes-{s}", {x: np.minimum(y, 65535).astype(np.uint16) for x, y in codes.items()})
                    elias_fano.remove(folder, f"shares-{s}")
            yield batch

    shards = -(-sum(w[1] for w in words) // shard_tokens)
    spark.range(0, shards, 1, min(shards, 4 * common.partitions(spark))).mapInArrow(smooth, "id long").agg(F.count("*")).collect()
    return model


def weighed(sums: list[tuple[int, int]]) -> tuple[float, ...]:
    """The weight of the shorter context by band, from tokens and how many of them are new; the band below where there are none."""
    out: list[float] = []
    for tokens, fresh in sums:
        out.append((fresh + 0.5) / (tokens + 1) if tokens or not out else out[-1])
    return tuple(out)


def probabilities(t: Trie, r: Read) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the single and of the interpolated probability of each token."""
    u, v = r.pairs // r.n, r.pairs % r.n
    single = (r.count + 0.5) / t.below
    p, bands, shard, place = t.pairs(r.ids[u], r.count[u], r.before[u], r.ids[v])
    if len(t.weights):
        p += np.where(r.count[u] > 0, t.weights[0][band(r.count[u])], 1.0) * single[v]
        rest = np.where(place >= 0, t.weights[1][bands], 1.0)
    else:
        p, rest = single[v], np.ones(len(v))
    both, three = np.unique(r.pair[r.inner] * r.n + r.tokens[r.inner + 1], return_inverse=True)
    found = t.triples(shard[both // r.n], place[both // r.n], r.ids[both % r.n])
    out = p[r.pair]
    out[r.inner + 1] = found[three] + rest[r.pair[r.inner]] * out[r.inner + 1]
    return np.log10(single)[r.tokens], np.log10(out)


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, n_known, train_tokens, base_score, score. No shuffle.

    Null and empty texts are one end. Without training texts every token has the probability of the one unknown class.
    Repeated rows and null ids give rows of their own; other columns are not read. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(*model)
        for batch, texts in common.pieces(batches):
            r = Read(t, texts)
            single, full = probabilities(t, r)
            ends = np.cumsum(r.counts)

            def sums(x: np.ndarray, starts: np.ndarray = ends - r.counts) -> np.ndarray:
                return np.add.reduceat(x, starts)

            columns = [pa.array(r.counts), pa.array(sums((r.count > 0).astype(np.int64)[r.tokens])), pa.array(np.full(len(ends), t.tokens)), pa.array(sums(single)), pa.array(sums(full))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.remainder("doc_id", 5) == 1
    out = score(docs, learn(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
SQL: dict[str, str] = {}
