"""Assurance edges and their rollup: what is known about a document beyond its own detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .detect import MATERIALITY, level, named

COLUMNS = ["doc_id", "boundary", "materiality", "reason", "finding_ids"]
# Boundaries, channels, nodes and hashes that are kept, and below the reasons of edges.
MAX_NODES, MAX_HASHES = 2_000, 100
CLAIM_BOUNDARIES = ["instruction", "authority", "identity", "destination", "executable", "financial", "other"]
CHANNELS = ["raw_bytes", "unicode", "human_projection", "normalization", "hidden", "browser", "model_tokens", "model_input", "semantic", "lineage"]


def _edge(rows: DataFrame, boundary, materiality, reason: str, ids=None) -> DataFrame:
    one = [F.lit(x) if isinstance(x, str) else x for x in (boundary, materiality)]
    none = F.array().cast("array<string>") if ids is None else ids
    return rows.select("doc_id", one[0].alias("boundary"), one[1].alias("materiality"), F.lit(reason).alias("reason"), none.alias("finding_ids"))


def radial_edges(rows: DataFrame) -> DataFrame:
    """rows: analysed documents, or doc_id and `edges`."""
    each = rows.select("doc_id", F.explode_outer("edges").alias("e")).filter("e IS NOT NULL").select("doc_id", "e.*")
    return _edge(each.filter("relation = 'divergence'"), F.col("boundary"), F.col("materiality"), "representation-divergence", F.col("finding_ids"))


def identity_edges(docs: DataFrame, table: dict[str, str]) -> DataFrame:
    """docs: doc_id, visible, expected_identity. Names that differ are material where they look alike."""
    of = T.skeleton(table)
    seen = F.regexp_replace("visible", r"(?U)^\s+|\s+$", "")
    rows = docs.filter(F.col("expected_identity").isNotNull()).withColumn("seen", seen).filter("seen <> expected_identity")
    rows = rows.withColumns({"a": of("seen"), "b": of("expected_identity")})
    return _edge(rows, "identity", F.when(F.col("a") == F.col("b"), "potentially-material").otherwise("context-dependent"), "declared-identity-mismatch")


def hidden_edges(hidden: DataFrame, found: DataFrame) -> DataFrame:
    """hidden: doc_id, texts. Hidden text counts where a finding shows it."""
    shown = found.filter(F.col("category").isin("ascii-smuggling", "hidden-html-css")).groupBy("doc_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return _edge(hidden.filter("size(texts) > 0").join(shown, "doc_id"), "hidden-content", "potentially-material", "content-not-present-in-human-view", F.col("ids"))


def token_edges(views: DataFrame) -> DataFrame:
    """views: doc_id, machine_tokens, human_tokens, as a tokenizer UDF made them."""
    return _edge(views.filter("machine_tokens <> human_tokens"), "model-tokenization", "context-dependent", "exact-token-sequences-differ")


def model_edges(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, model_text (null: not observed)."""
    return _edge(docs.filter("model_text <> text"), "model-input", "potentially-material", "exact-model-input-differs")


def _concealed() -> Column:
    return F.filter(F.slice("nodes", 1, MAX_NODES), lambda n: ~n["visible"] & n["text"].rlike(r"(?U)\S"))


def concealed(docs: DataFrame) -> DataFrame:
    """doc_id, n, sha256: nodes that a browser hides, and hashes of the first of their texts."""
    rows = docs.select("doc_id", _concealed().alias("x")).filter("size(x) > 0")
    return rows.select("doc_id", F.size("x").alias("n"), F.slice(F.transform("x", lambda n: T.sha256(n["text"])), 1, MAX_HASHES).alias("sha256"))


def browser_edges(docs: DataFrame) -> DataFrame:
    """docs: doc_id, nodes array<struct<visible,text>>."""
    return _edge(docs.filter(F.size(_concealed()) > 0), "rendered-hidden-content", "potentially-material", "computed-style-hidden-text")


def valid_claims(claims: DataFrame, views: DataFrame) -> DataFrame:
    """claims: doc_id, boundary, materiality, evidence array<struct<view,start,end,text,sha256>>, explanation. views: doc_id, machine, human.

    `valid` is true where boundary and materiality are known, there are 1 to 100 spans, and each lies in its view with
    the text and digest that it states.
    """
    rows = claims.join(views, "doc_id", "left")

    def good(e):
        text = F.when(e["view"] == "machine", F.col("machine")).when(e["view"] == "human", F.col("human"))
        part = F.substr(text, e["start"] + 1, e["end"] - e["start"])
        inside = (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text))
        return F.coalesce(inside & (e["text"].isNull() | (e["text"] == part)) & (e["sha256"].isNull() | (e["sha256"] == T.sha256(part))), F.lit(False))

    known = F.col("boundary").isin(CLAIM_BOUNDARIES) & F.col("materiality").isin(MATERIALITY)
    return rows.withColumn("valid", F.coalesce(known & F.size("evidence").between(1, 100) & F.forall("evidence", good), F.lit(False))).withColumn("explanation", F.substring("explanation", 1, 4096)).drop("machine", "human")


def claim_edges(claims: DataFrame) -> DataFrame:
    return _edge(claims.filter("valid AND materiality <> 'none'"), F.col("boundary"), F.col("materiality"), "trusted-semantic-observer-claim")


def rollup(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """doc_id, disposition, material, edges, complete. docs: doc_id, status; a text that was not decoded or is over a budget is unavailable."""
    every = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    rolled = every.groupBy("doc_id").agg(F.max(level(F.col("materiality"), MATERIALITY)).alias("most"), F.count("*").alias("n"))
    rows = docs.select("doc_id", "status").join(rolled, "doc_id", "left")
    here = F.col("status") == "admitted"
    return rows.select("doc_id", F.when(here, named(F.col("most"), MATERIALITY)).otherwise("unavailable").alias("disposition"), F.when(here, F.coalesce(F.col("most") >= 2, F.lit(False))).alias("material"), F.coalesce("n", F.lit(0)).alias("edges"), F.lit(False).alias("complete"))


#: How each channel is observed where the columns of an analysed document have it.
OBSERVED = {"raw_bytes": ("text", "available"), "unicode": ("findings", "available"), "human_projection": ("visible", "heuristic"), "normalization": ("views.nfc", "available"), "hidden": ("hidden", "available"), "browser": ("browser_text", "available"), "model_tokens": ("machine_tokens", "available"), "model_input": ("model_text", "available"), "semantic": ("claims", "advisory"), "lineage": ("lineage", "supplied")}


def coverage(rows: DataFrame) -> Column:
    """A struct of CHANNELS for each analysed document: how the channel was observed, `unavailable` where it was not."""
    def one(channel: str) -> Column:
        column, how = OBSERVED[channel]
        seen = F.col(column).isNotNull() if column.split(".")[0] in rows.columns else F.lit(False)
        return F.when(seen, how).otherwise("unavailable").alias(channel)

    return F.struct(*map(one, CHANNELS))


def attached(rows: DataFrame, rolled: DataFrame) -> DataFrame:
    """Analysed documents with the struct `assurance` (disposition, material, edges, complete, coverage); their summary gets
    assurance_disposition, and is material if either is. Reports made of the result get receipts of their own. A document
    without a verdict keeps a null summary.
    """
    parts = rolled.select("doc_id", F.struct("disposition", "material", "edges", "complete").alias("rolled"))
    out = rows.withColumn("coverage", coverage(rows)).join(parts, "doc_id", "left")
    out = out.withColumn("assurance", F.struct("rolled.*", "coverage"))
    either = F.col("summary.material_divergence") | F.coalesce("rolled.material", F.lit(False))
    with_it = F.struct("summary.finding_count", "summary.severity", either.alias("material_divergence"), "summary.categories", F.col("rolled.disposition").alias("assurance_disposition"))
    return out.withColumn("summary", F.when(F.col("summary").isNotNull(), with_it)).drop("rolled", "coverage")
