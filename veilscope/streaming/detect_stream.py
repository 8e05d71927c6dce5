"""Streams of documents and of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import analysis, detect

#: Milliseconds after which a document that gets no more chunks is given up.
PATIENCE = 3_600_000


def findings(docs: DataFrame, table: dict[str, str]) -> DataFrame:
    """Findings of a stream of documents, in append mode: every detector works inside its row and keeps no state."""
    return detect.findings(docs, table)


def analyzed(docs: DataFrame, table: dict[str, str]) -> DataFrame:
    """The whole analysis of a stream of documents, in append mode and without state."""
    return analysis.analyzed(docs, table)


def assembled(chunks: DataFrame, max_bytes: int = 256_000, patience: int = PATIENCE) -> DataFrame:
    """chunks: doc_id long, seq long, chunk binary, last boolean; in any order, over any number of batches, any of them again.

    A document comes out when all chunks up to its last one are there: doc_id, content, byte_length, complete, reason. A
    chunk counts once by its number. Once over the cap, its bytes are let go, and it comes out with null content when its
    last chunk is in. One that gets no chunk for `patience` milliseconds comes out incomplete, and its state goes.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, sizes, parts, last = state.get if state.exists else ([], [], [], -1)
        sizes, parts = dict(zip(seqs, sizes, strict=True)), dict(zip(seqs, parts, strict=True))
        for frame in rows:
            for seq, chunk, end in zip(frame["seq"], frame["chunk"], frame["last"], strict=True):
                if int(seq) not in parts:
                    sizes[int(seq)], parts[int(seq)] = len(chunk), bytes(chunk)
                last = int(seq) if end else last
        total = sum(sizes.values())
        over, whole = total > max_bytes, last >= 0 and sorted(parts) == list(range(last + 1))
        if over:
            parts = dict.fromkeys(parts, b"")
        if whole or state.hasTimedOut:
            state.remove()
            content = b"".join(parts[k] for k in sorted(parts)) if whole and not over else None
            reason = "over the cap" if over else None if whole else "no more chunks"
            yield pd.DataFrame({"doc_id": [key[0]], "content": [content], "byte_length": [total], "complete": [reason is None], "reason": [reason]})
        else:
            state.update((list(parts), list(sizes.values()), list(parts.values()), last))
            state.setTimeoutDuration(patience)

    out = "doc_id long, content binary, byte_length long, complete boolean, reason string"
    held = "seqs array<long>, sizes array<long>, parts array<binary>, last long"
    return chunks.groupBy("doc_id").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.ProcessingTimeTimeout)
