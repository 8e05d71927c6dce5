"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol a byte, in a doubly linked list. The adjacent pair of the lowest rank is popped
from a heap and merged, again and again; the count is the initial symbols less the merges, and no identifier is made.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: What the file must do to a text, and what is done here: compose, make white space one space, fold to lower case.
NORMALIZERS = ["Lowercase", "NFC", "Replace"]
#: Words whose counts a Python worker remembers before it starts afresh.
REMEMBERED = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Counts of words, made when first asked for. path: a `tokenizers` file with a byte-level model and word ends."""

    def __init__(self, path: str):
        super().__init__()
        file = json.load(open(path, encoding="utf-8"))
        model = file["model"]
        kinds = [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [file["normalizer"] or {"type": None}])]
        if model["type"] != "BPE" or sorted(map(str, kinds)) != NORMALIZERS:
            raise ValueError(f"{path} is no byte-pair vocabulary with the normalisers {NORMALIZERS}")
        vocabulary, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in file["added_tokens"]) or r"(?!)")
        self.piece = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.pieces: dict[str, int] = {}
        letters = byte_letters()
        self.inner = [vocabulary[x] for x in letters]
        self.last = [vocabulary[x + self.end] for x in letters]
        #: Left and right symbol as one number -> rank and the merged symbol as one number.
        self.merges = {vocabulary[a] << 20 | vocabulary[b]: rank << 20 | vocabulary[a + b] for rank, (a, b) in enumerate(model["merges"])}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
            self.pieces.clear()
        n = self[word] = self.text(word.decode("utf-8", "replace"))
        return n

    def text(self, text: str) -> int:
        total = at = 0
        for m in self.special.finditer(text):
            total += 1 + self.plain(text[at : m.start()])
            at = m.end()
        return total + self.plain(text[at:])

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form: letters fold one by one
        total = 0
        for p in self.piece.findall(text.lower()):
            if (n := self.pieces.get(p)) is None:
                n = self.pieces[p] = self.merged(p.encode())
            total += n
        return total

    def merged(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in piece]
        symbol[-1] = self.last[piece[-1]]
        after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], self.merges
        heap = []
        for i in range(n - 1):
            if (m := merges.get(symbol[i] << 20 | symbol[i + 1])) is not None:
                heap.append((m >> 20, i, m))
        heapify(heap)
        count = n
        while heap:
            _, i, m = heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j < 0 or merges.get(symbol[i] << 20 | symbol[j]) != m:
                continue  # one of the two was merged meanwhile
            symbol[i], symbol[j] = m & 0xFFFFF, -1
            count -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := merges.get(symbol[i] << 20 | symbol[k])) is not None:
                    heappush(heap, (m >> 20, i, m))
            if (h := before[i]) >= 0 and (m := merges.get(symbol[h] << 20 | symbol[i])) is not None:
                heappush(heap, (m >> 20, h, m))
        return count


@lru_cache(1)
def counter(path: str) -> Counter:
    """One in each Python worker; it outlives a task."""
    return Counter(path)


def token_counts(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_tokens, over_limit.

    The tokenizer never joins what white space divides, so that words are counted one by one and their counts kept.
    Null counts as empty: 0 bytes, 0 tokens. A file with another model or other normalisers raises. Other columns are not read. path must be readable on every executor; the
    default is the file of the installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or public_tokenizers.path(VOCABULARY))
        for batch, texts in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([sum(map(count.__getitem__, t.split())) for t in texts], pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
