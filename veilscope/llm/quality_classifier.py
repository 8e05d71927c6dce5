"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a low-rank vector; the sum over all pairs of dot products is half of (square of the
sum less sum of the squares) for each factor, so that a text is scored in time linear in its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, RANK = 1 << 15, 8
#: Bound of the training sample: labelled rows of each class, by hashed id. Their texts are read whole, on the executors.
SAMPLE = 4_000
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.05, 1e-5
_UPPER, _LOWER, _DIGITS, _MARKS = (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"#*$%&|<>{}[]\\^~_=+@")
STATISTICS = ["chars", "words", "mean_word", "capitals", "letters", "digits", "marks", "bangs", "stops", "lines", "same_lines", "distinct", "doubled", "n_chars"]


def features(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of the hashed words (log counts of unit length), and the dense statistics.

    n_chars is the table's own column, NaN where it is null.
    """
    codes, counts, distinct = common.coded(texts)
    n = len(texts)
    buckets = (common.hashed(distinct) % np.uint64(BUCKETS)).astype(np.int64)
    row = np.repeat(np.arange(n), counts)
    cells, times = np.unique(row * BUCKETS + buckets[codes], return_counts=True)
    r, c = cells // BUCKETS, cells % BUCKETS
    x = np.log1p(times)
    x /= np.sqrt(np.bincount(r, x * x, n))[r] if len(r) else 1
    size = np.fromiter(map(len, texts), float, n)
    kinds = np.bincount(np.unique(row * max(1, len(distinct)) + codes) // max(1, len(distinct)), minlength=n)
    doubled = np.bincount(row[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])], minlength=n)
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.fromiter(map(len, lines), float, n)

    def share(chars: bytes) -> np.ndarray:
        return np.fromiter((len(t) - len(t.translate(None, chars)) for t in texts), float, n) / np.maximum(size, 1)

    n_words = np.maximum(counts, 1)
    plain = np.where(np.isnan(n_chars), size, n_chars)
    dense = [np.log1p(size) / 10, np.log1p(counts) / 8, np.log1p(size / n_words) / 4, share(_UPPER), share(_LOWER), share(_DIGITS) * 4, share(_MARKS) * 4, share(b"!") * 4, share(b".,;:?") * 4]
    dense += [np.log1p(n_lines) / 5, 1 - np.fromiter((len(set(x)) for x in lines), float, n) / n_lines, kinds / n_words, doubled / n_words, np.log1p(plain) / 10]
    return r, c, x, np.column_stack(dense) if n else np.empty((0, len(STATISTICS)))


class Machine:
    """Weights: bias, linear, and vectors of BUCKETS hashed words followed by the statistics."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.linear = 0.0, np.zeros(BUCKETS + len(STATISTICS))
        self.vectors = rng.normal(0, 0.05, (BUCKETS + len(STATISTICS), RANK))
        self.shift = np.zeros(len(STATISTICS))
        self.scale = np.ones(len(STATISTICS))

    def merged(self, r: np.ndarray, c: np.ndarray, x: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = dense.shape
        z = np.clip((dense - self.shift) / self.scale, -4, 4)
        return np.concatenate([r, np.repeat(np.arange(n), k)]), np.concatenate([c, np.tile(BUCKETS + np.arange(k), n)]), np.concatenate([x, z.ravel()])

    def raw(self, r: np.ndarray, c: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of each factor."""
        vx = self.vectors[c] * x[:, None]
        sums = np.column_stack([np.bincount(r, vx[:, f], n) for f in range(RANK)])
        squares = np.bincount(r, (vx * vx).sum(1), n)
        return self.bias + np.bincount(r, self.linear[c] * x, n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, texts: list[bytes], n_chars: np.ndarray) -> np.ndarray:
        *cells, dense = features(texts, n_chars)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.merged(*cells, dense), len(texts))[0], -30, 30)))

    def fit(self, r: np.ndarray, c: np.ndarray, x: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Machine:
        """Logistic loss by AdaGrad over small batches, from what features gives; weight of each row."""
        rng, n = np.random.default_rng(seed), len(y)
        self.shift, self.scale = dense.mean(0), dense.std(0) + 1e-6
        r, c, x = self.merged(r, c, x, dense)
        order = np.argsort(r, kind="stable")
        r, c, x = r[order], c[order], x[order]
        edges = np.searchsorted(r, np.arange(n + 1))
        past_linear, past_vectors, past_bias = np.full(self.linear.shape, 1e-2), np.full(self.vectors.shape, 1e-2), 1e-2
        for _ in range(EPOCHS):
            shuffled = rng.permutation(n)
            for at in range(0, n, BATCH):
                own = shuffled[at : at + BATCH]
                cells = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in own])
                row, col, val = np.repeat(np.arange(len(own)), np.diff(edges)[own]), c[cells], x[cells]
                s, sums = self.raw(row, col, val, len(own))
                g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[own]) * weight[own] / len(own)
                names, inverse = np.unique(col, return_inverse=True)
                gx = g[row] * val
                step = np.bincount(inverse, gx, len(names)) + DECAY * self.linear[names]
                past_linear[names] += step * step
                pulls = gx[:, None] * (sums[row] - self.vectors[col] * val[:, None])
                turn = np.column_stack([np.bincount(inverse, pulls[:, f], len(names)) for f in range(RANK)]) + DECAY * self.vectors[names]
                past_vectors[names] += turn * turn
                self.linear[names] -= RATE * step / np.sqrt(past_linear[names])
                self.vectors[names] -= RATE * turn / np.sqrt(past_vectors[names])
                past_bias += g.sum() ** 2
                self.bias -= RATE * g.sum() / np.sqrt(past_bias)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from at most `sample` labelled rows of each class, the ones with the smallest hashed ids.

    Rows weigh so that the classes keep their shares among all labelled rows. Without both classes the machine gives
    the one class, or 0.5 without labels. Of repeated rows of a document and label one is learned from, so that the
    sample stays bounded. The driver gets the features of the sample, at most BUCKETS for a text, and no text.
    """
    marks = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("y"))
    shares = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    h = F.xxhash64("doc_id")
    chosen = []
    for k, n in sorted(shares.items()):
        chosen += marks.filter((F.col("y") == k) & common.lowest(h, 2 * sample, n)).orderBy(h, "doc_id").limit(sample).collect()  # bounded
    machine = Machine()
    if not chosen:
        return machine
    ids = docs.sparkSession.createDataFrame(chosen, marks.schema)
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(ids.distinct()), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "n_chars")).alias("x")).select(F.xxhash64("doc_id").alias("h"), F.col("y").cast("int").alias("y"), "x.text", "x.n_chars")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.pieces(batches):
            r, c, x, dense = features(texts, lengths(batch.column(3)))
            edges = np.searchsorted(r, np.arange(len(texts) + 1))
            cells = [pa.array([v[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)], pa.binary()) for v in (c.astype("<i4"), x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells, pa.array([d.tobytes() for d in dense], pa.binary())], ["h", "y", "c", "x", "dense"])

    got = sorted(map(tuple, rows.mapInArrow(read, "h long, y int, c binary, x binary, dense binary").toLocalIterator()))
    y = np.array([g[1] for g in got], float)
    if not len(y) or y.min() == y.max():
        machine.bias = 0.0 if not len(y) else (10.0 if y[0] else -10.0)
        machine.vectors[:] = 0
        return machine
    total = sum(shares.values())
    weight = np.where(y == 1, shares[1] / total / y.mean(), shares[0] / total / (1 - y.mean()))
    c, x, dense = (np.frombuffer(b"".join(g[i] for g in got), kind) for i, kind in ((2, "<i4"), (3, "<f8"), (4, "<f8")))
    r = np.repeat(np.arange(len(got)), [len(g[2]) // 4 for g in got])
    return machine.fit(r, c.astype(np.int64), x, dense.reshape(len(got), -1), y, np.maximum(weight, 0.2))


def lengths(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def classify(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row for each row of docs: doc_id, score. The whole text is scored; null and empty texts get the score of no words.

    n_chars is metadata: where the column is null, the bytes of the text stand in. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.score(texts, lengths(batch.column(2))))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, x) for x in ("documents", "labels"))
    machine = train(docs, labels.filter(common.remainder("doc_id", 3) != 1))
    out = classify(docs, machine)
    return out.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_factorisation_machine": op4_factorisation_machine}
SQL: dict[str, str] = {}
