"""Best-fit packing with Martello and Toth's dominance reduction.

A length has few values, so that the whole instance is its histogram of lengths, bounded by the sequence length. The
driver solves the histogram: first it fixes small sets that provably dominate every other set with the same largest
piece, then it packs the rest by best fit, longest first. The plan holds ranges of ranks inside a length; the pieces
get their ranks from counts by length and salt, and look up their place without meeting in one task.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import byte_letters

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1
#: Rows of one length that are ranked together, about: a longer list is dealt to more parts. The driver gets a count for each.
PART_ROWS = 250_000
REMEMBERED = 700_000
#: Words that are pieces as they stand: letters, then marks.
_PLAIN = regex.compile(r"(\p{L}*)([.,;:!?|]*)")


class Ids(dict):
    """Token ids of words as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.runs, self.letters = self.tokenizer.model, {}, byte_letters()

    def run(self, run: str) -> bytes:
        """Ids of a run of small letters, or of marks: such a run is one piece for the model, byte by byte."""
        if (got := self.runs.get(run)) is None:
            mapped = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
            got = self.runs[run] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return got

    def __missing__(self, word: bytes) -> bytes:
        """The tokenizer joins nothing across white space, so that words are encoded once. Plain ones go to its model."""
        if len(self) > REMEMBERED:
            self.clear()
            self.runs.clear()
        text = word.decode("utf-8", "replace")
        same = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if plain := _PLAIN.fullmatch(same.lower()):
            got = b"".join(self.run(x) for x in plain.groups() if x)
        else:
            got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = got
        return got

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        return (b"".join(map(self.__getitem__, t.split())) for t in texts)


@lru_cache(1)
def ids(path: str) -> Ids:
    return Ids(path)


def cut(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: id, piece, start, length, ids_crc32. Null counts as empty: one piece, the end id."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids(path or public_tokenizers.path(VOCABULARY))
        for batch, texts in common.pieces(batches):
            row, piece, length, crc = [], [], [], []
            for i, body in enumerate(encode.of(texts)):
                body += end
                for k, at in enumerate(range(0, len(body), 4 * capacity)):
                    own = body[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            p = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), p, pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(common.lean(run), f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that may be fixed, as (lengths, how often), and the counts that remain.

    A set with largest piece w dominates another with w if the other's further pieces can be dealt to the set's so
    that none is outweighed; then some best packing holds the set. With room = capacity - w and v the longest piece
    that fits, {w} is fixed if nothing fits; {w, v} if v fills the room, or no two pieces fit, or no three fit and no
    pair outweighs v; {w, v, b}, with b the longest piece that fits beside v, if no three pieces fit and the shorter of any
    pair is at most b. More of the same set stay dominating as counts fall, so that sets are fixed in bulk.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: dict[tuple[int, ...], int] = {}
    moved = True
    while moved:
        moved = False
        for w in sorted(left, reverse=True):
            while left.get(w):
                found = dominating(w, left, capacity)
                if not found:
                    break
                need = {k: found.count(k) for k in found}
                times = min(left[k] // n for k, n in need.items())
                fixed[found] = fixed.get(found, 0) + times
                for k, n in need.items():
                    left[k] -= n * times
                    if not left[k]:
                        del left[k]
                moved = True
    return list(fixed.items()), left


def dominating(w: int, left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """The set with w that dominates all others with w in what is left, if one of the tests shows one."""
    rest = dict(left)
    rest[w] -= 1
    if not rest[w]:
        del rest[w]
    room, keys = capacity - w, sorted(rest)
    low = [k for k in keys[:3] for _ in range(min(3, rest[k]))][:3]
    if not low or low[0] > room:
        return (w,)
    v = keys[bisect_right(keys, room) - 1]
    if v == room or len(low) < 2 or low[0] + low[1] > room:
        return (w, v)
    if len(low) > 2 and sum(low) <= room:
        return None
    fit = keys[: bisect_right(keys, room)]

    def partner(y: int) -> int:
        """The longest piece beside y, at least as long as y; 0 if there is none."""
        x = fit[bisect_right(fit, room - y) - 1] if bisect_right(fit, room - y) else 0
        return x if x > y or x == y and rest[y] > 1 else 0

    pairs = [(y, partner(y)) for y in fit if 2 * y <= room]
    pairs = [(y, x) for y, x in pairs if x]
    if max((y + x for y, x in pairs), default=0) <= v:
        return (w, v)
    beside = [k for k in fit[: bisect_right(fit, room - v)] if k != v or rest[v] > 1]
    if beside and max(y for y, _ in pairs) <= beside[-1]:
        return (w, v, beside[-1])
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many)], how often): best fit, longest first, over equal bins at once.

    The bin with the least room that still takes a piece takes the next ones too, while they fit: its room has become
    the least. So bins of one room take pieces of one length in bulk, and a length adds at most three patterns.
    """
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {capacity: []}
    rooms: list[int] = []

    def put(room: int, pattern: list[tuple[int, int]], n: int) -> None:
        if n:
            if not bins.setdefault(room, []):
                rooms.insert(bisect_left(rooms, room), room)
            bins[room].append((pattern, n))

    for w in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        c = counts[w]
        while c:
            at = bisect_left(rooms, w)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // w
            if at < len(rooms):
                pattern, n = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
            else:
                pattern, n = [], -(-c // each)
            full = min(n, c // each)
            put(room - each * w, [*pattern, (w, each)], full)
            c -= full * each
            if full < n and c:
                put(room - c * w, [*pattern, (w, c)], 1)
                c, full = 0, full + 1
            put(room, pattern, n - full if pattern else 0)
    return [x for own in bins.values() for x in own]


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Ranges of ranks: rows (length, first rank, first sequence, how many of the length in a sequence, offset of the first)."""
    fixed, left = reduced(counts, capacity)
    patterns = [([(k, s.count(k)) for k in dict.fromkeys(s)], n) for s, n in fixed] + best_fit(left, capacity)
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for w, each in pattern:
            out.append((w, used.get(w, 0), sequence, each, offset))
            used[w] = used.get(w, 0) + n * each
            offset += w * each
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than capacity are cut into full pieces and a rest; all pieces are then packed. Null texts are
    empty documents, one end id each; repeated rows are packed each by itself; an empty table gives no rows. Other
    columns are not read; the id may have any name but those of the other columns that are returned. The pieces are
    written once in the shared folder, so that no text is encoded twice.
    """
    spark = df.sparkSession
    done = common.saved(spark, cut(df, path, capacity, end_id, id_col, text_col).withColumnRenamed(id_col, "id"), "pieces")
    sizes = {r["length"]: r["count"] for r in done.groupBy("length").count().collect()}  # at most capacity rows
    parts = [1 + sizes.get(w, 0) // part_rows for w in range(capacity + 1)]
    first = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
    part = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.get(F.lit(parts), F.col("length").cast("int"))).cast("int")
    done = done.withColumn("part", part)
    cells = np.zeros(first[-1], np.int64)
    for r in done.groupBy("length", "part").count().collect():  # a row a part
        cells[first[r["length"]] + r["part"]] = r["count"]
    before = np.cumsum(cells) - cells
    before -= np.repeat(before[first[:-1]], parts)  # pieces of a length in earlier parts
    plan = planned(sizes, capacity)
    shift = np.int64(1 << 44)
    starts = plan[:, 0] * shift + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            rank = before[first[length] + part] + n - 1
            row = plan[np.searchsorted(starts, length * shift + rank, side="right") - 1]
            inside = rank - row[:, 1]
            sequence, slot = row[:, 2] + inside // row[:, 3], inside % row[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(row[:, 4] + slot * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = done.withColumn("n", F.row_number().over(order))
    kind = done.schema["id"].dataType.simpleString()
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "part", "n").mapInArrow(common.lean(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. Null and repeated ids and null texts are packed as pack says."""
    common.tune(spark)
    return pack(docs)


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
SQL: dict[str, str] = {}
