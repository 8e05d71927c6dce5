"""Chat formatting by columnar byte assembly.

A turn becomes `<s>[INST]role[/INST]text</s>`. A control string inside a role or text gets one more backslash after its
first character, which reading back takes away. Lengths of all segments of a batch give their offsets by a cumulative
sum; headers and contents are scattered into one preallocated buffer, which Arrow takes as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
#: A conversation's output is cut between turns into parts of about so many bytes, so that no task holds it whole.
PART_BYTES = 8_000_000


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column.fill_null("").cast(pa.string()), _CONTROL, r"\1\\\2").cast(pa.large_binary())


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_binary array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def assembled(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns one after another, where each turn starts (and the last ends), and where its text starts."""
    sources = [content(escaped(role)), content(escaped(text))]
    n = len(role)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, [0, 2, 4]] = len(OPEN), len(MIDDLE), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = (np.diff(o) for o, _ in sources)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, header in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(header))] = np.frombuffer(header, np.uint8)
    for k, (offsets, data) in ((1, sources[0]), (3, sources[1])):
        at = np.arange(offsets[0], offsets[-1]) if n else np.empty(0, np.int64)
        out[at + np.repeat(starts[:, k] - offsets[:-1], lengths[:, k])] = data[at]
    return out, np.append(starts[:, 0], len(out)), starts[:, 3]


def chat_format(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows conv, part, n_turns, formatted, mask: the parts of a conversation in order, in one partition, side by side.

    mask lists the byte ranges of the assistant's texts in formatted. Turns go by turn_col, nulls first; equal turns by
    role and text, so that repeated rows are turns of their own. Null roles and texts are empty; rows with a null
    conversation are one. Extra columns are not read. A task streams its rows and holds one batch or part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, role, text = batch.columns
            if not len(conv):
                continue
            out, starts, texts = assembled(role, text)
            names = conv.to_pylist()
            first, marks = 0, pa.array(role).fill_null("").to_pylist()
            cuts = [0]
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[first] or starts[i + 1] - starts[cuts[-1]] > PART_BYTES:
                    cuts.append(i)
                    first = i if i < len(names) else first
            edges = np.array(cuts)
            masks = [[{"start": int(texts[i] - starts[a]), "end": int(starts[i + 1] - len(CLOSE) - starts[a])} for i in range(a, b) if marks[i] == "assistant"] for a, b in zip(cuts, cuts[1:], strict=False)]
            formatted = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(starts[edges].astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(cuts[:-1])), pa.array(np.diff(edges)), formatted.cast(pa.string()), pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv", "n_turns", "formatted", "mask"])

    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return rows.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, n_turns long, formatted string, mask array<struct<start:long,end:long>>")


def read_back(parts: DataFrame) -> DataFrame:
    """One row for each conversation, from the output alone: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = None
        open_: list = []

        def row() -> list:
            conv, turns, seen, loss, chars, total = open_
            return [conv, turns, seen.hexdigest(), chars, loss.hexdigest(), total]

        def made(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for conv, _, formatted, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or open_[0] != conv:
                    if open_:
                        done.append(row())
                    open_ = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, text in _TURN.findall(formatted):
                    open_[1] += 1
                    open_[2].update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                data = formatted.encode()
                for m in mask:
                    text = unescaped(data[m["start"] : m["end"]].decode())
                    open_[3].update(text.encode())
                    open_[4] += len(text)
                open_[5] += len(formatted)
            if done:
                yield made(done)
        if open_:
            yield made([row()])

    return parts.mapInArrow(run, f"conv {parts.schema['conv'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(chat_format(rows.unionByName(added))).withColumnRenamed("conv", "conv_id")


_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(regexp_replace(role || chr(0) || text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) - 1)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

QUERIES = {"op7_chat_format": op7_chat_format}
SQL = {"op7_chat_format": _SQL}
