"""The whole analysis of a document in one row: budgets first, then views, findings, edges and verdict, from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode_tables as U
from . import compare, detect

#: What an analysis adds to a document.
RESULT = ["status", "reason", "visible", "views", "findings", "edges", "summary", "radial", "hidden", "semantic"]


def analyzed(docs: DataFrame, table: dict[str, str], overrides: dict[str, str] | None = None, max_chars: int = detect.MAX_CHARS, max_bytes: int = detect.MAX_BYTES, max_findings: int = detect.MAX_FINDINGS) -> DataFrame:
    """docs with the columns of RESULT.

    docs: doc_id, text, and optionally the struct `html` of operators.html and browser_text. status is `admitted`, `rejected`
    (over a budget of characters, bytes or findings) or `undecodable` (no text); reason says why. Only admitted documents
    have the other columns: a document that was not analysed is never clean. No shuffle; one Arrow UDF makes the normal
    forms of texts beyond ASCII.
    """
    rows = detect.admitted(docs, max_chars, max_bytes)
    here = F.col("status") == "admitted"
    if "html" in docs.columns:
        rows = rows.withColumn("html", F.when(here, F.col("html")))
    rows = detect.detected(rows.withColumn("given", F.col("text")).withColumn("text", F.when(here, F.col("text"))), U.combined(table, overrides))
    over = here & (F.size("findings") > max_findings)
    rows = rows.withColumn("reason", F.when(over, "finding budget exceeded").otherwise(F.col("reason"))).withColumn("status", F.when(over, "rejected").otherwise(F.col("status")))
    rows = rows.withColumn("text", F.when(here, F.col("text")))
    rows = rows.withColumns({f"view_{k}": detect.once(v) for k, v in compare.view_columns(docs, F.col("forms")).items()})
    views = {n: F.col(f"view_{n}") for n in compare.names(rows)}
    rows = rows.withColumn("edges", detect.once(compare.edges_of(views, F.col("findings"))))
    hidden = hidden_of(docs)
    made = {
        "visible": views["human_projection"],
        "views": F.struct(*[views[n].alias(n) for n in sorted(views)]),
        "findings": F.col("findings"),
        "edges": F.col("edges"),
        "summary": compare.summary_of(F.col("findings")),
        "radial": compare.radial_of(F.col("edges")),
        "hidden": hidden,
        "semantic": semantic_of(docs),
    }
    rows = rows.select(*[F.col("given").alias("text") if c == "text" else F.col(c) for c in docs.columns], "status", "reason", *[F.when(here, v).alias(k) for k, v in made.items()])
    return rows


def hidden_of(docs: DataFrame) -> Column:
    """What a reader does not see: payloads of tag characters, invisible characters, and a page's hidden parts."""
    shown = F.filter("findings", lambda f: f["category"] == "invisible-unicode")
    parts = {"tag_payloads": F.transform("runs", lambda r: r["decoded"]), "invisible": F.transform(shown, lambda f: F.struct(f["start"].alias("start"), f["detail"].alias("codepoint")))}
    if "html" in docs.columns:
        parts |= {"fragments": F.col("html.hidden"), "attributes": F.col("html.attrs"), "comments": F.col("html.comments")}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def semantic_of(docs: DataFrame) -> Column:
    """What was seen, what was received, what was hidden, and the categories that make the difference material."""
    texts = F.transform("runs", lambda r: r["decoded"])
    if "html" in docs.columns:
        pages = F.concat(F.transform("html.hidden", lambda x: x["text"]), F.transform("html.attrs", lambda x: x["text"]))
        texts = F.concat(texts, F.coalesce(pages, F.array().cast("array<string>")))
    material = F.filter("findings", lambda f: f["materiality"].isin(detect.MATERIALITY[2:]))
    basis = F.array_sort(F.array_distinct(F.transform(material, lambda f: f["category"])))
    parts = {"human_visible_text": F.col("view_human_projection"), "machine_received_text": F.col("text"), "decoded_hidden_text": texts, "material_divergence": F.size(material) > 0, "basis": basis}
    return F.struct(*[v.alias(k) for k, v in parts.items()])
