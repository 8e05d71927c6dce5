"""Reports of analysed documents: a JSON body, and its text, HTML and SARIF forms as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import integrity

SCHEMA, ENGINE = "veilscope.report.v1", "2"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: What a page may load: nothing but its own style.
POLICY = "default-src 'none'; style-src 'unsafe-inline'"
HEADLINES = ["Representation report", "A clean result covers the observers that ran; what did not run says nothing."]


def given(text: Column) -> Column:
    return F.struct(T.sha256(text).alias("sha256"), F.length(text).alias("char_length"), F.octet_length(text).alias("byte_length"))


def reports(rows: DataFrame, receipt: bool = True) -> DataFrame:
    """Analysed documents with the column `report`: canonical JSON with its receipt, or plain JSON without one.

    A document that was not admitted has a report of its status and reason, and no verdict. lineage and assurance are taken
    over if they are columns.
    """
    here = F.col("status") == "admitted"
    text = F.col("text")
    hashed = F.struct(*[F.struct(F.col(f"views.{n}").alias("text"), T.sha256(F.col(f"views.{n}")).alias("sha256")).alias(n) for n in rows.schema["views"].dataType.names])
    views = [hashed.alias("texts"), "edges", "radial", "hidden", "semantic", *[c for c in ("lineage", "assurance") if c in rows.columns]]
    body = F.struct(F.lit(SCHEMA).alias("schema"), F.lit(ENGINE).alias("engine_version"), "status", "reason", F.when(text.isNotNull(), given(text)).alias("input"), F.when(here, F.struct(*views)).alias("views"), "summary", "findings")
    plain = F.to_json(body)
    return rows.withColumn("report", integrity.with_receipt(plain) if receipt else plain)


def _lines(receipt: Column) -> Column:
    place = lambda f: F.coalesce(F.concat(F.lit(" at ["), f["start"].cast("string"), F.lit(":"), f["end"].cast("string"), F.lit("]")), F.lit(""))
    line = lambda f: F.concat(F.lit("- ["), F.upper(f["severity"]), F.lit("] "), f["category"], place(f), F.lit(": "), f["explanation"], F.when(f["evidence"] != "{}", F.concat(F.lit("\n  Evidence: "), f["evidence"])).otherwise(""))
    listed = F.when(F.size("findings") > 0, F.array_join(F.transform("findings", line), "\n")).otherwise("- None")
    verdict = F.when(F.col("summary.material_divergence"), "YES").otherwise("NO")
    return F.array(F.lit(HEADLINES[0]), F.concat(F.lit("Schema: "), F.lit(SCHEMA)), F.concat(F.lit("Severity: "), F.upper("summary.severity")), F.concat(F.lit("Material divergence: "), verdict), F.concat(F.lit("Disposition: "), F.col("radial.disposition")), F.lit(HEADLINES[1]), F.concat(F.lit("Findings: "), F.col("summary.finding_count").cast("string")), F.lit(""), F.lit("Human-visible representation:"), F.col("visible"), F.lit(""), F.lit("Findings:"), listed, F.lit(""), F.concat(F.lit("Report SHA-256: "), receipt))


def receipt_of(report: Column) -> Column:
    return F.get_json_object(report, "$.receipt.canonical_json_sha256")


def text_report(rows: DataFrame) -> Column:
    """Lines for a reader: verdict, what is visible, findings with their evidence, and the receipt. A document without a
    verdict has its reason.
    """
    refused = F.concat(F.lit(HEADLINES[0] + "\nNo verdict: "), F.col("reason"))
    return F.when(F.col("status") == "admitted", F.array_join(_lines(F.coalesce(receipt_of(F.col("report")), F.lit("none"))), "\n")).otherwise(refused)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_report(rows: DataFrame) -> Column:
    """A page with a table of findings that loads nothing; null where the report's receipt does not hold."""
    cell = lambda x: F.concat(F.lit("<td>"), escaped(F.coalesce(x.cast("string"), F.lit(""))), F.lit("</td>"))
    line = lambda f: F.concat(F.lit("<tr>"), *[cell(f[k]) for k in ("severity", "category", "start", "end", "explanation", "evidence")], F.lit("</tr>"))
    heads = "".join(f"<th>{x}</th>" for x in ("severity", "category", "start", "end", "explanation", "evidence"))
    table = F.concat(F.lit(f"<table><tr>{heads}</tr>"), F.array_join(F.transform("findings", line), ""), F.lit("</table>"))
    start = f'<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>{HEADLINES[0]}</title></head><body><pre>'
    page = F.concat(F.lit(start), escaped(text_report(rows)), F.lit("</pre>"), F.coalesce(table, F.lit("")), F.lit("</body></html>"))
    return F.when(integrity.verified("report"), page)


def position(text: Column, at: Column) -> tuple[Column, Column]:
    """Line and column of a place, from 1, in code points."""
    before = F.substr(text, F.lit(1), at)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line, F.length(F.substring_index(before, "\n", -1)) + 1


GRADES = {"critical": "error", "high": "error", "medium": "warning"}


def located(text: Column, f: Column) -> dict[str, Column]:
    """level, start_line, start_col, end_line, end_col, source_offset of a finding in its text.

    Findings without a place have nulls; a start beyond the text, or in undecoded bytes (null text), is a source_offset.
    """
    inside = F.coalesce(f["start"].between(0, F.length(text)), F.lit(False))
    ends = inside & (f["end"] > f["start"]) & (f["end"] <= F.length(text))
    (a, b), (c, d) = position(text, f["start"]), position(text, f["end"])
    grade = F.coalesce(F.try_element_at(F.map_from_arrays(F.lit(list(GRADES)), F.lit(list(GRADES.values()))), f["severity"]), F.lit("note"))
    return {"level": grade, "start_line": F.when(inside, a), "start_col": F.when(inside, b), "end_line": F.when(ends, c), "end_col": F.when(ends, d), "source_offset": F.when(~inside, f["start"])}


def locations(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text, findings. doc_id, finding_id, category, materiality and what located gives, for each finding."""
    text = F.col("text")
    some = F.transform("findings", lambda f: F.struct(f["id"].alias("finding_id"), f["category"].alias("category"), f["materiality"].alias("materiality"), *[v.alias(k) for k, v in located(text, f).items()]))
    return rows.select("doc_id", F.explode_outer(some).alias("x")).filter("x IS NOT NULL").select("doc_id", "x.*")


def sarif(rows: DataFrame, uri: Column | None = None) -> DataFrame:
    """rows: doc_id, text, findings. doc_id, run: one SARIF run a document as JSON, with an empty list of results where there
    are no findings; null where there is no verdict. The rules are the distinct categories.
    """
    uri, text = F.lit("evidence.txt") if uri is None else uri, F.col("text")

    def result(f: Column) -> Column:
        at = located(text, f)
        region = F.struct(*[at[a].alias(b) for a, b in (("start_line", "startLine"), ("start_col", "startColumn"), ("end_line", "endLine"), ("end_col", "endColumn"))])
        place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
        said = F.struct(f["id"].alias("finding_id"), f["materiality"].alias("materiality"), at["source_offset"].alias("source_offset"), F.when(at["source_offset"].isNotNull(), "not-in-the-decoded-text").alias("location_status"))
        return F.struct(f["category"].alias("ruleId"), at["level"].alias("level"), F.struct(f["explanation"].alias("text")).alias("message"), said.alias("properties"), F.when(at["start_line"].isNotNull(), F.array(place)).alias("locations"))

    rules = F.transform(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["category"]))), lambda c: F.struct(c.alias("id")))
    driver = F.struct(F.lit("veilscope").alias("name"), F.lit(ENGINE).alias("version"), rules.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("findings", result).alias("results"))
    return rows.select("doc_id", F.when(F.col("findings").isNotNull(), F.to_json(run)).alias("run"))


def sarif_file(runs: DataFrame, files: int = 1) -> DataFrame:
    """file, sarif: the runs of documents in order, dealt to so many files by hashed id. A file is one string in one task, so
    that `files` must grow with the documents: some ten thousand a file.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "run"))), lambda x: x["run"]), ",")
    grouped = runs.filter("run IS NOT NULL").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file"))
    return grouped.agg(F.concat(F.lit(f'{{"version":"2.1.0","$schema":"{SARIF_SCHEMA}","runs":['), joined, F.lit("]}")).alias("sarif"))


def failed(rows: DataFrame) -> bool:
    """Whether any analysed document diverges materially, or has no verdict, as an exit code asks."""
    return bool(rows.agg(F.bool_or(F.coalesce("summary.material_divergence", F.lit(True)))).first()[0])
