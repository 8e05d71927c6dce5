"""Elias-Fano sequences in flat arrays, searched for many values at once, and files of arrays that are mapped into memory."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs

_ONE = np.uint64(1)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A rising sequence of numbers below universe: low bits packed, high bits in unary, zeros counted before each word."""
    n = len(values)
    bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    shift = np.uint64(bits)
    values = values.astype(np.uint64)
    high = (values >> shift).astype(np.int64)
    unary = np.zeros(-(-(n + (universe >> bits) + 2) // 64) * 64, np.uint8)
    unary[high + np.arange(n)] = 1
    words = np.packbits(unary, bitorder="little").view(np.uint64)
    ones = np.cumsum(np.bitwise_count(words).astype(np.int64))
    zeros = 64 * np.arange(len(words) + 1) - np.concatenate([[0], ones])
    packed = []
    places = np.arange(bits, dtype=np.uint64)
    for at in range(0, n, 1 << 15):
        part = values[at : at + (1 << 15), None] >> places & _ONE
        packed.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
    low = np.concatenate([*packed, np.zeros(16, np.uint8)])
    low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)]).view(np.uint64)
    return {"shape": np.array([n, bits], np.int64), "low": low, "words": words, "zeros": zeros}


class Sequence:
    """Search in an encoded sequence; its arrays may be mapped from a file."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        (n, bits), self.low, self.words, self.zeros = (arrays[prefix + x] for x in ("shape", "low", "words", "zeros"))
        self.n, self.bits = int(n), int(bits)
        self.mask = np.uint64((1 << self.bits) - 1)

    def lows(self, i: np.ndarray) -> np.ndarray:
        bit = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        rest = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> off | rest) & self.mask

    def starts(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits below bucket: the place of the zero before it, less the zeros up to there."""
        k = bucket - 1
        word = np.searchsorted(self.zeros, np.maximum(k, 0), side="right") - 1
        left, place = np.maximum(k, 0) - self.zeros[word], np.zeros(len(k), np.int64)
        rest = ~self.words[word]
        for width in (32, 16, 8, 4, 2, 1):
            part = rest & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            up = left >= ones
            left, place = np.where(up, left - ones, left), np.where(up, place + width, place)
            rest = np.where(up, rest >> np.uint64(width), part)
        return np.where(k < 0, 0, 64 * word + place - k)

    def successors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element that is at least each value, as far as its bucket goes, and whether it is equal."""
        values = values.astype(np.uint64)
        bucket, wanted = (values >> np.uint64(self.bits)).astype(np.int64), values & self.mask
        lo, end = self.starts(bucket), self.starts(bucket + 1)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < wanted[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        found = lo < end
        found[found] = self.lows(lo[found]) == wanted[found]
        return lo, found


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder. Hadoop's name for S3 is known under its plain one."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """A file of arrays in a shared folder. It appears whole or not at all, so that a task may be run again."""
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    head, at, body = {}, 0, []
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[k] = (a.dtype.str, at, a.nbytes)
        body += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
        at += a.nbytes + -a.nbytes % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for x in body:
            out.write(x)
    store.move(part, f"{path}/{name}")


def remove(folder: str, name: str) -> None:
    """Deletes a file, if it is there."""
    store, path = store_of(folder)
    with contextlib.suppress(FileNotFoundError):
        store.delete_file(f"{path}/{name}")


@lru_cache(4096)
def mapped(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped read-only; None if there is none. Of a store that cannot be mapped the file is read."""
    store, path = store_of(folder)
    path = f"{path}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.exists(path):
            return None
        data = np.memmap(path, np.uint8, "r")
    elif store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    else:
        with store.open_input_file(path) as file:
            data = np.frombuffer(file.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    return {k: data[8 + size + at : 8 + size + at + n].view(kind) for k, (kind, at, n) in head.items()}
