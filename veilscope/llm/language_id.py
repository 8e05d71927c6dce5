"""Language identification by compression.

Every language gets a raw-content zstandard dictionary made of a bounded sample of its labelled texts. The letters
of a whole text are encoded with each dictionary; the language with the fewest bytes wins. A text is rejected where the
margin to the others is narrow: no byte between the best two, or about three languages as likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bound of the training sample: whole texts of a language, and of all languages together, of which each has one at least.
SAMPLE_TEXTS, SAMPLE_ALL = 250, 8_000
#: Rows that are ranked for each that is sampled; the rest makes up for hashes that are spread unevenly.
SPARE = 4
LEVEL = 9
#: Bytes between the best and the second language that count as one unit of evidence.
UNIT = 4.0
#: A document is rejected if the score, the softmax of the sizes, is below this, or fewer bytes than NARROW tell the best two apart.
MARGIN, NARROW = 0.36, 1
_OTHER, _OTHER_ASCII = regex.compile(r"\P{L}+"), regex.compile("[^a-z]+")


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Dictionary content for each language, from the texts with the smallest hashed ids.

    Every language that has a text with a letter is learned, from whole texts. At most SAMPLE_ALL texts reach the driver, or one
    a language: of very many languages each gives fewer. What is ranked is first cut by the hash to about SPARE
    times what is wanted, so that a language with most of the rows costs no more than another.
    """
    lang, h = F.col(lang_col), F.xxhash64(F.col(id_col))
    usable = labelled.filter(lang.isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy(lang.alias("lang")).count().collect()}
    texts = max(1, min(texts, SAMPLE_ALL // max(1, len(sizes))))
    large = [F.lit(x) for k, n in sizes.items() if n > SPARE * texts for x in (k, ((SPARE * texts) << 64) // n - (1 << 63))]
    cut = F.try_element_at(F.create_map(*large), lang) if large else F.lit(None).cast("long")
    rows = usable.filter(cut.isNull() | (h < cut))
    ranked = rows.select(lang.alias("lang"), h.alias("h"), F.col(text_col).alias("text"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("n") <= texts)
    found: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "n").select("lang", "text").toLocalIterator():
        found.setdefault(r["lang"], []).append(r["text"])
    return {k: b"".join(map(prepared, reversed(v))) for k, v in found.items()}


def prepared(text: str) -> bytes:
    """Lower-case letters, with one space for each run of anything else: case, digits and marks tell no language."""
    text = text.lower()
    return f" {(_OTHER_ASCII if text.isascii() else _OTHER).sub(' ', text).strip()} ".encode()


def coders(model: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    """Compressors with digested dictionaries, made once in each Python worker."""

    def make() -> list[zstandard.ZstdCompressor]:
        made = []
        for _, content in model:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False))
        return made

    return common.kept((hash(model), level), make)


def scored(batches: Iterator[pa.RecordBatch], model: tuple[tuple[str, bytes], ...], text: str, level: int, unit: float, margin: float) -> Iterator[tuple[pa.RecordBatch, list[str], list[float], list[bool]]]:
    """Slices of the batches, with the language and the score of each row, and whether it is rejected."""
    made = coders(model, level)
    for batch, texts in common.pieces(batches, text):
        names, scores, rejected = [], [], []
        for t in texts:
            t = prepared(t.decode("utf-8", "replace"))
            if not made or not t.strip():
                names.append("und")
                scores.append(0.0)
                rejected.append(True)
                continue
            sizes = np.array([len(c.compress(t)) for c in made], float)
            best = int(sizes.argmin())
            names.append(model[best][0])
            scores.append(float(1 / np.exp(np.maximum((sizes[best] - sizes) / unit, -50)).sum()))
            rejected.append(scores[-1] < margin or np.count_nonzero(sizes < sizes[best] + NARROW) > 1)
        yield batch, names, scores, rejected


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, unit: float = UNIT, margin: float = MARGIN) -> DataFrame:
    """One row for each row of df: id, lang_pred, score (0 to 1), rejected.

    Null texts and texts without a letter, or no dictionaries at all, give `und`, score 0, rejected. Ties go to the
    first language by name and are rejected. Repeated rows give repeated rows; other columns are not read.
    """
    model = tuple(sorted(dictionaries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores, rejected in scored(batches, model, "text", level, unit, margin):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(common.lean(run, keep=True), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def accepted(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = LEVEL, unit: float = UNIT, margin: float = MARGIN) -> DataFrame:
    """The rows of df that identify does not reject, whole. Each row has its own decision, so that ids may be null or repeat."""
    model = tuple(sorted(dictionaries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, rejected in scored(batches, model, text_col, level, unit, margin):
            yield batch.filter(pa.array([not x for x in rejected], pa.bool_()))

    return df.mapInArrow(common.lean(run, keep=True), df.schema)


def learned(docs: DataFrame) -> dict[str, bytes]:
    """From rows whose remainder modulo 4 is not 2."""
    return sample(docs.filter(common.remainder("doc_id", 4) != 2))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, learned(docs))
    return out.select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that identify rejects go."""
    common.tune(spark)
    return accepted(docs, learned(docs))


QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
