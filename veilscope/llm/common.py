"""What the operators share: reading tables, scratch tables in the shared folder, words and shingles in Arrow."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every operator here, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that an Arrow operator works on at a time.
CHUNK_BYTES = 4_000_000
_ROOTS: dict[str, str] = {}
#: What the operator that a Python worker last ran keeps between its tasks: one entry.
_KEPT: dict[Any, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, whatever store it is in."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, by rows and by bytes, so that a batch of long texts fits an executor and its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a local run gets a temporary one; a cluster,
    whose executors share no local folder, an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="veilscope-")
        _ROOTS[app] = f"{base.rstrip('/')}/scratch-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _ROOTS[app])
    return _ROOTS[app]


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: this cuts lineage and survives lost executors."""
    return saved_at(spark, df, name)[0]


def saved_at(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As saved, with the path, for a caller that drops the table before the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    collected(spark)
    return spark.read.schema(df.schema).parquet(path), path


def collected(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to."""
    spark.sparkContext._jvm.System.gc()


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, made once in a Python worker, until another key is asked for or an operator without a model runs."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forgotten() -> None:
    _KEPT.clear()


def given_back() -> None:
    """Free memory of this Python worker goes back to the system: the worker stays for other operators' tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, without a model that an earlier operator kept (keep: its own stays), and with free memory given back at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forgotten()
        try:
            yield from run(batches)
        finally:
            given_back()

    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def lowest(h: Column, wanted: int, count: int) -> Column:
    """Whether a 64-bit hash is among the lowest, of which `count` rows have about `wanted`. True if there are no more.

    A filter before a rank of the lowest: what is then shuffled does not grow with the table.
    """
    return h < F.lit((wanted << 64) // count - (1 << 63)) if count > wanted else F.lit(True)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.fill_null("").cast(pa.binary())


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most so many bytes of text, or one row; with their texts."""
    for batch in batches:
        texts = as_binary(batch.column(batch.schema.get_field_index(text))).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if len(texts) > start:
            yield batch.slice(start), texts[start:]


def coded(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of the texts as codes, the number of words of each text, and the distinct words that the codes stand for.

    bytes.split() divides at exactly the characters of SPACE, and bytes.lower() folds A-Z only.
    """
    seen: dict[bytes, int] = {}
    codes: list[int] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = (t.lower() if fold else t).split()
        counts[i] = len(own)
        codes += [seen.setdefault(w, len(seen)) for w in own]
    return np.array(codes, np.int64), counts, list(seen)


def hashed(distinct: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(counts: np.ndarray) -> np.ndarray:
    """Start of each run, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
