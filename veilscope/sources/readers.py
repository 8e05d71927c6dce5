"""Sources: bytes with a content type to texts; what cannot be read becomes a row with a reason."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
MAX_CHARS, MAX_TEXT = 64_000, 256_000
MAX_BYTES, MAX_MEMBERS, MAX_EXPANDED, MAX_RATIO, MAX_MEMBER, MAX_PAGES = 4_000_000, 1000, 16_000_000, 1000, 4_000_000, 100
SUFFIXES = {".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html", ".xhtml": "application/xhtml+xml", ".json": "application/json", ".xml": "application/xml", ".js": "text/javascript", ".pdf": "application/pdf"}
SUFFIXES |= {f".{x}": f"application/vnd.openxmlformats-officedocument.{y}" for x, y in (("docx", "wordprocessingml.document"), ("xlsx", "spreadsheetml.sheet"), ("pptx", "presentationml.presentation"))}
PASSED = ["application/json", "application/xml", "application/javascript"]
PARTS = ("document.xml", "header", "footer", "sharedStrings.xml", "worksheets/", "slides/", "notesSlides/", "comments")
OFFICE = "application/vnd.openxmlformats-officedocument"
_TEXT_PART = re.compile(r"^(word|xl|ppt)/(?=.*(" + "|".join(map(re.escape, PARTS)) + r")).*\.xml$")
_DECLARED = re.compile(rb"<!(DOCTYPE|ENTITY)")


def content_type(filename: Column, given: Column | None = None, content: Column | None = None) -> Column:
    """The given type without parameters, in lower case; else by the file name's end; else by the first bytes."""
    guess = F.lit("application/octet-stream")
    if content is not None:  # a PDF says so; a ZIP may be an office document, whose parts tell
        guess = F.when(F.hex(F.substring(content, 1, 5)) == "255044462D", "application/pdf").when(F.hex(F.substring(content, 1, 4)) == "504B0304", OFFICE).otherwise(guess)
    for end, kind in SUFFIXES.items():
        guess = F.when(F.lower(filename).endswith(end), kind).otherwise(guess)
    return guess if given is None else F.coalesce(F.nullif(F.trim(F.split(F.lower(given), ";")[0]), F.lit("")), guess)


def files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, filename, length, content, content_type of all files below a path; bytes stay bytes.

    The bytes of a file over the cap are not read: its content is null. What a path lists are regular files; a store's own
    links are followed, so that a folder of untrusted links has to be checked before.
    """
    rows = spark.read.format("binaryFile").load(path)
    small = rows.filter(F.col("length") <= max_bytes)  # reaches the source, which reads no larger file
    large = rows.filter(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    both = small.select("path", "length", "content").unionByName(large)
    name = F.element_at(F.split("path", "/"), -1)
    return both.select(F.xxhash64("path").alias("doc_id"), name.alias("filename"), "length", "content", content_type(name, content=F.col("content")).alias("content_type"))


def office_parts(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The parts of an office document that hold text, if it stays within the bounds."""
    listed = z.infolist()
    faults = {
        "too many parts": len(listed) > MAX_MEMBERS,
        "unpacks to too much": sum(m.file_size for m in listed) > MAX_EXPANDED,
        "is packed too tightly": max((m.file_size / m.compress_size for m in listed if m.compress_size), default=0) > MAX_RATIO,
        "has a part that is too large": any(m.file_size > MAX_MEMBER for m in listed if _TEXT_PART.search(m.filename)),
    }
    if found := [what for what, holds in faults.items() if holds]:
        raise ValueError("the document " + ", ".join(found))
    return [m for m in listed if _TEXT_PART.search(m.filename)]


def xml_texts(data: bytes) -> list[str]:
    """The texts of all t and v elements, whatever their namespace. A document type or entity is refused."""
    if _DECLARED.search(data):
        raise ValueError("the document declares a type or an entity")
    events = ElementTree.iterparse(io.BytesIO(data))
    return [node.text for _, node in events if node.text and node.tag.split("}")[-1] in ("t", "v")]


def office_text(content: bytes) -> str:
    """The text of the parts that hold text, in the order of the file, a line for each piece."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n".join(text for part in office_parts(z) for text in xml_texts(z.read(part)))


def pdf_text(content: bytes) -> str:
    """The text of all pages; needs pypdf."""
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(content), strict=True)
    if reader.is_encrypted or len(reader.pages) > MAX_PAGES:
        raise ValueError("encrypted or too many pages")
    return "\n".join(p.extract_text() or "" for p in reader.pages)


def _reader(of: Callable[[bytes], str]):
    @F.pandas_udf("text string, reason string")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((of(c), None))
            except Exception as e:  # a bad file is a rejected row, not a failed job
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "reason"])

    return run


def acquired(rows: DataFrame) -> DataFrame:
    """rows: doc_id, content, content_type. With text, status, reason and the lineage columns source_sha256 and source_bytes.

    Formats are read by branches, so that a UDF gets only its own rows. Unknown types with a zero byte near the start,
    unsupported types and files over the cap are rejected; text types with invalid UTF-8 are undecodable.
    """
    size = F.coalesce(F.length("content"), F.col("length") if "length" in rows.columns else F.lit(None))
    rows = rows.withColumns({"source_sha256": F.sha2("content", 256), "source_bytes": size})
    office, pdf = F.col("content_type").startswith("application/vnd.openxmlformats"), F.col("content_type") == "application/pdf"
    plain = F.col("content_type").startswith("text/") | F.col("content_type").isin(PASSED)
    small = (F.col("source_bytes") <= MAX_BYTES) & F.col("content").isNotNull()
    texts = rows.filter(small & plain).withColumn("text", F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))).withColumn("reason", F.when(F.col("text").isNull(), "invalid-utf8"))
    out = [texts]
    for kind, of in ((office, office_text), (pdf, pdf_text)):
        out.append(rows.filter(small & kind & ~plain).withColumn("r", _reader(of)("content")).select("*", "r.text", "r.reason").drop("r"))
    rest = rows.filter(~(small & (plain | office | pdf)))
    binary = F.contains(F.substring("content", 1, 4096), F.unhex(F.lit("00")))
    reason = F.when(~small, "intake limit exceeded").when(binary & (F.col("content_type") == "application/octet-stream"), "binary").otherwise("unsupported format")
    out.append(rest.withColumn("text", F.lit(None).cast("string")).withColumn("reason", reason))
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    status = F.when(F.col("text").isNotNull(), "admitted").when(F.col("reason") == "invalid-utf8", "undecodable").otherwise("rejected")
    return done.withColumn("status", status)


def reassembled(chunks: DataFrame, max_bytes: int = 256_000) -> DataFrame:
    """chunks: doc_id, seq (from 0), chunk, and optionally last (boolean). One row for each document: content, source_sha256,
    byte_length, complete, reason.

    A chunk that is delivered again counts once; two that differ under one number, a number that is missing or a last chunk
    that is not there (if `last` is a column) leave a document incomplete: its content is null. So does a size over the cap:
    what is collected of a document is bounded by the cap first, by a running sum in the order of its chunks.
    """
    ended = F.max(F.col("last").cast("int")) if "last" in chunks.columns else F.lit(1)
    kinds = chunks.groupBy("doc_id", "seq").agg(F.min("chunk").alias("chunk"), F.max("chunk").alias("other"), ended.alias("last"))
    own = Window.partitionBy("doc_id").orderBy("seq")
    kinds = kinds.withColumn("so_far", F.sum(F.coalesce(F.length("chunk"), F.lit(0))).over(own))
    held = F.when(F.col("so_far") <= max_bytes, F.struct("seq", F.hex("chunk").alias("x")))
    rows = kinds.groupBy("doc_id").agg(F.sum(F.length("chunk")).alias("byte_length"), F.array_sort(F.collect_list(held)).alias("parts"), F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("final"), F.bool_or(~F.col("chunk").eqNullSafe(F.col("other"))).alias("differ"), F.max_by("last", "seq").alias("ended"))
    reason = F.when(F.col("byte_length") > max_bytes, "over the cap").when(F.col("differ"), "chunks differ under one number").when((F.col("first") != 0) | (F.col("final") != F.col("n") - 1), "a chunk is missing").when(F.col("ended") != 1, "the last chunk is missing")
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), ""))
    rows = rows.withColumn("reason", reason).withColumn("complete", F.col("reason").isNull()).withColumn("content", F.when(F.col("complete"), whole))
    return rows.select("doc_id", "content", F.sha2("content", 256).alias("source_sha256"), "byte_length", "complete", "reason")


def requests(rows: DataFrame, column: str = "request") -> DataFrame:
    """rows with JSON requests {text, content_type?, provenance?, browser?}: text, content_type, provenance (JSON), browser,
    status, reason. A request that breaks a rule is a rejected row with its reason and no text.
    """
    v = F.try_parse_json(column)
    field = lambda name: F.expr(f"try_variant_get(__v, '$.{name}', 'variant')")
    kind = lambda name: F.schema_of_variant(field(name))
    rows = rows.withColumn("__v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    text = F.expr("try_variant_get(__v, '$.text', 'string')")
    given = F.expr("try_variant_get(__v, '$.content_type', 'string')")
    absent = lambda name: field(name).isNull() | kind(name).isin("VOID")
    provenance = F.when(~absent("provenance"), F.get_json_object(F.col(column), "$.provenance"))
    browser = F.coalesce(F.expr("try_variant_get(__v, '$.browser', 'boolean')"), F.lit(False))
    kept = F.when(F.col("__v").isNull(), "not an object").when(field("text").isNull() | (kind("text") != "STRING"), "text is no string")
    kept = kept.when((F.length(text) > MAX_CHARS) | (F.octet_length(text) > MAX_TEXT), "text is over the budget")
    kept = kept.when(field("content_type").isNotNull() & ((kind("content_type") != "STRING") | (F.length(given) > 200)), "content_type is no short string")
    kept = kept.when(~absent("provenance") & ~kind("provenance").startswith("OBJECT"), "provenance is no object").when(F.octet_length(provenance) > MAX_CHARS, "provenance is over the budget")
    kept = kept.when(field("browser").isNotNull() & (kind("browser") != "BOOLEAN"), "browser is no boolean")
    kind_of = F.coalesce(given, F.lit("text/plain"))
    kept = kept.when(browser & ~(F.lower(kind_of).startswith("text/html") | F.lower(kind_of).startswith("application/xhtml+xml")), "a browser needs HTML")
    out = rows.withColumn("reason", kept)
    good = F.col("reason").isNull()
    made = {"text": text, "content_type": kind_of, "provenance": provenance, "browser": browser}
    return out.withColumns({k: F.when(good, x) for k, x in made.items()} | {"status": F.when(good, "admitted").otherwise("rejected")}).drop("__v")
