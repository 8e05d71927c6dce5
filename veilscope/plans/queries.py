"""The queries over the engine's operators, and the same queries as SQL.

The tables hold no anomalies, so that the queries inject one kind for each remainder of the id, the same in both engines.
The SQL names its characters itself and shares no class or table with the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hooks
from ..functions import text as T
from ..functions import unicode_tables as U
from ..operators import analysis, assurance, compare, detect, html
from ..sinks import integrity, reports
from ..sources import readers

_TAGGED = lambda s: "".join(chr(0xE0000 + ord(c)) for c in s)
#: Remainder of doc_id modulo 10 -> what is added to the text, as a function of the text column.
INJECTED = {
    1: lambda t: F.concat(F.substring(t, 1, 3), F.lit("​"), F.substr(t, F.lit(4), F.length(t))),
    2: lambda t: F.concat(t, F.lit("‮")),
    3: lambda t: F.concat(t, F.lit("‎")),
    4: lambda t: F.concat(t, F.lit(_TAGGED("HI"))),
    5: lambda t: F.concat(t, F.lit("\U0001f3f4" + _TAGGED("gbeng") + "\U000e007f")),
    6: lambda t: F.translate(t, "o", "о"),
    7: lambda t: F.concat(F.lit("Ａ"), t),
    8: lambda t: F.concat(t, F.lit("​" * 4)),
    9: lambda t: F.concat(t, F.lit("\U0001f468‍\U0001f469")),
}
_DOCS = """
WITH d AS (SELECT doc_id, CASE doc_id % 10
  WHEN 1 THEN substr(text, 1, 3) || chr(8203) || substr(text, 4)
  WHEN 2 THEN text || chr(8238) WHEN 3 THEN text || chr(8206)
  WHEN 4 THEN text || chr(917576) || chr(917577)
  WHEN 5 THEN text || chr(127988) || chr(917607) || chr(917602) || chr(917605) || chr(917614) || chr(917607) || chr(917631)
  WHEN 6 THEN translate(text, 'o', chr(1086)) WHEN 7 THEN chr(65313) || text
  WHEN 8 THEN text || chr(8203) || chr(8203) || chr(8203) || chr(8203)
  WHEN 9 THEN text || chr(128104) || chr(8205) || chr(128105) ELSE text END AS text FROM documents)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their injected anomalies: doc_id, text."""
    text: Column = F.col("text")
    case = F
    for k, add in INJECTED.items():
        case = case.when(F.col("doc_id") % 10 == k, add(text))
    return _table(spark, sf_dir, "documents").select("doc_id", case.otherwise(text).alias("text"))


def human_projection(spark, sf_dir):
    visible = T.human_projection(F.col("text"))
    return evidence(spark, sf_dir).select("doc_id", F.length(visible).alias("visible_len"), T.sha256(visible).alias("visible_sha256"))


def raw_views(spark, sf_dir):
    text = F.col("text")
    return evidence(spark, sf_dir).select("doc_id", F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), T.sha256(text).alias("sha256"), F.md5(T.raw_hex(text)).alias("hex_md5"))


def tag_stripped(spark, sf_dir):
    text = T.tag_stripped(F.col("text"))
    return evidence(spark, sf_dir).select("doc_id", F.length(text).alias("len"), T.sha256(text).alias("sha256"))


def compact_skeleton(spark, sf_dir):
    return evidence(spark, sf_dir).select("doc_id", T.sha256(T.compact_skeleton(F.col("text"))).alias("skeleton_sha256"))


def invisible_findings(spark, sf_dir):
    rows = detect.invisible(evidence(spark, sf_dir))
    return rows.select("doc_id", F.col("start").alias("idx"), F.col("detail").alias("codepoint"), "severity", "materiality")


def bidi_findings(spark, sf_dir):
    return detect.bidi(evidence(spark, sf_dir)).select("doc_id", F.col("start").alias("idx"), F.col("detail").alias("strength"), "severity", "materiality")


def carrier_patterns(spark, sf_dir):
    return detect.carriers(evidence(spark, sf_dir)).select("doc_id", "carriers", "distinct_carriers", "suspicious")


def tag_runs(spark, sf_dir):
    return detect.tag_runs(evidence(spark, sf_dir)).select("doc_id", "n", "start", "end", "decoded", "terminated", F.when(F.col("flag"), "unicode-tag-sequence").otherwise("ascii-smuggling").alias("category"))


def emoji_zwj(spark, sf_dir):
    rows = detect.invisible(evidence(spark, sf_dir)).filter("detail = 'U+200D'")
    return rows.select("doc_id", F.col("start").alias("idx"), F.get_json_object("evidence", "$.emoji_context").cast("boolean").alias("emoji_context"))


def normalization_nfc(spark, sf_dir):
    nfc = T.normalized("NFC")("text")
    return evidence(spark, sf_dir).select("doc_id", T.sha256(nfc).alias("nfc_sha256"), (nfc != F.col("text")).alias("changed"))


def normalization_delta(spark, sf_dir):
    rows = detect.normalization(evidence(spark, sf_dir)).filter("nfkc_changed")
    return rows.select("doc_id", T.sha256(F.col("nfkc")).alias("nfkc_sha256"), "materiality")


def _table_of(spark: SparkSession) -> dict[str, str]:
    return U.default_confusables(spark)


def confusable_findings(spark, sf_dir):
    rows = detect.confusables(evidence(spark, sf_dir), _table_of(spark))
    return rows.select("doc_id", F.size("positions").alias("n_positions"), F.get("positions", F.lit(0)).alias("first_position"), F.array_join("scripts", ",").alias("scripts"), "mixed")


def confusable_skeleton(spark, sf_dir):
    rows = T.with_forms(evidence(spark, sf_dir), _table_of(spark), F.col("text"))
    composed = T.normalized("NFC")("forms.skeleton")
    return rows.select("doc_id", T.sha256(composed).alias("skeleton_sha256"))


def script_families(spark, sf_dir):
    return evidence(spark, sf_dir).select("doc_id", F.array_join(detect.scripts_of(F.col("text"), T.odd(F.col("text"))), ",").alias("scripts"))


def character_names(spark, sf_dir):
    """The invisible characters of all documents, with what the character database says of them."""
    rows = detect.with_spots(evidence(spark, sf_dir), "invisible").select(F.explode_outer("spots").alias("x")).filter("x IS NOT NULL")
    known = F.broadcast(U.ucd(spark).select("ch", "cp", "category", "bidi", "name", F.coalesce("script", F.lit("")).alias("script")))  # one row a character
    return rows.join(known, F.col("x.c") == F.col("ch"), "left").groupBy("cp", "category", "bidi", "name", "script").agg(F.count("*").alias("n"))


def lookalike_pairs(spark, sf_dir):
    """Every document and a twin of some in which a letter is exchanged."""
    docs = evidence(spark, sf_dir)
    twins = _table(spark, sf_dir, "documents").filter("doc_id % 10 = 6").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    return compare.lookalikes(docs.unionByName(twins), T.sha256(T.compact_skeleton(F.col("text"))))


def _three_views(spark, sf_dir):
    docs = evidence(spark, sf_dir)
    return docs.withColumns({"view_machine": F.col("text"), "view_human_projection": T.human_projection(F.col("text")), "view_tag_stripped": T.tag_stripped(F.col("text"))})


def view_divergence(spark, sf_dir):
    rows = compare.comparisons(_three_views(spark, sf_dir))
    kept = ["doc_id", "left", "right", "relation", "prefix", "suffix", "first_difference", "length_delta", "left_sha256", "right_sha256", "left_length", "right_length", "left_fragment", "right_fragment"]
    return rows.select(*kept)


def _analyzed(spark, sf_dir, **budgets):
    """Without budgets, so that texts of any length have a verdict; analysis_budgets has some."""
    return analysis.analyzed(evidence(spark, sf_dir), _table_of(spark), **({"max_chars": 1 << 30, "max_bytes": 1 << 30} | budgets))


def _joined(name: str):
    return F.array_join(name, ",").alias(name.rsplit(".", 1)[-1])


def analysis_budgets(spark, sf_dir):
    rows = _analyzed(spark, sf_dir, max_chars=5_000, max_bytes=256_000, max_findings=4)
    return rows.select("doc_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.col("summary.finding_count").alias("finding_count"), F.col("radial.material").alias("material"))


def radial_edges(spark, sf_dir):
    rows = _analyzed(spark, sf_dir).select("doc_id", F.explode_outer("edges").alias("e")).filter("e IS NOT NULL").select("doc_id", "e.*")
    return rows.select("doc_id", "boundary", "relation", "materiality", F.array_join("evidence_categories", ",").alias("categories"), _joined("finding_ids"))


def radial_rollup(spark, sf_dir):
    return _analyzed(spark, sf_dir).select("doc_id", *[f"radial.{x}" for x in ("disposition", "material", "divergent", "agreeing", "promoted")], _joined("radial.boundaries"))


def document_summary(spark, sf_dir):
    return _analyzed(spark, sf_dir).select("doc_id", "summary.finding_count", "summary.severity", "summary.material_divergence", _joined("summary.categories"))


def category_groups(spark, sf_dir):
    return detect.by_category(detect.findings(evidence(spark, sf_dir), _table_of(spark))).withColumn("ids", F.array_join("ids", ","))


def hidden_projection(spark, sf_dir):
    rows = _analyzed(spark, sf_dir)
    return rows.select("doc_id", F.array_join("hidden.tag_payloads", ",").alias("payloads"), F.size("hidden.invisible").alias("invisible"), F.get("hidden.invisible", F.lit(0))["codepoint"].alias("first_codepoint"))


def semantic_view(spark, sf_dir):
    rows = _analyzed(spark, sf_dir).select("doc_id", "semantic.*")
    return rows.select("doc_id", T.sha256(F.col("human_visible_text")).alias("visible_sha256"), _joined("decoded_hidden_text"), "material_divergence", _joined("basis"))


def overridden_lookalikes(spark, sf_dir):
    """A caller's look-alikes win over the table's: one more letter, and one that is none any more."""
    rows = detect.findings(evidence(spark, sf_dir), _table_of(spark), {"é": "e", "о": "о"}).filter("category = 'confusable-homoglyph'")
    return rows.select("doc_id", "severity", F.get_json_object("evidence", "$.count").cast("int").alias("n"))


def sarif_locations(spark, sf_dir):
    text = F.col("text")
    docs = detect.with_spots(evidence(spark, sf_dir), "invisible")
    rows = reports.locations(docs.withColumn("findings", detect.once(detect.invisible_of(text, F.col("spots")))))
    return rows.select("doc_id", "finding_id", "level", "start_line", "start_col", "end_line", "end_col")


def sarif_runs(spark, sf_dir):
    rows = reports.sarif(_analyzed(spark, sf_dir))
    at = lambda path: F.get_json_object("run", path)
    return rows.select("doc_id", F.json_array_length(at("$.results")).alias("results"), at("$.tool.driver.rules").alias("rules"), F.coalesce(at("$.results[0].message.text"), F.lit("")).alias("message"))


def text_reports(spark, sf_dir):
    rows = reports.reports(_analyzed(spark, sf_dir, max_chars=5_000), receipt=False)
    lines = F.split(reports.text_report(rows), "\n")
    return rows.select("doc_id", F.get(lines, F.lit(1)).alias("line_1"), F.get(lines, F.lit(2)).alias("line_2"), F.get(lines, F.lit(3)).alias("line_3"))


def budget_rejects(spark, sf_dir):
    return detect.admitted(evidence(spark, sf_dir), max_chars=5_000, max_bytes=256_000).select("doc_id", "status", F.coalesce("reason", F.lit("")).alias("reason"))


def lexical_units(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(T.lexical_units(F.col("text"))).alias("token_count"))


def invalid_utf8(spark, sf_dir):
    files = evidence(spark, sf_dir).select("doc_id", F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 10 < 3, F.unhex(F.lit("FF41"))).otherwise(F.unhex(F.lit("41")))).alias("content"))
    return detect.invalid_utf8(files).select("doc_id", "start", "end", "detail", "severity")


def model_tokens(spark, sf_dir):
    """Tokens of both views, under the budgets of an analysis; a document beyond them has no tokens, which is not equality."""
    of = hooks.tokenizer(lambda t: t.split(" "))
    text = F.when(F.col("status") == "admitted", F.col("text"))
    rows = hooks.model_views(detect.admitted(evidence(spark, sf_dir)), of, text, T.human_projection(text))
    edges = assurance.token_edges(rows).select("doc_id", "materiality")
    return rows.select("doc_id", "equal", "token_count_delta").join(edges, "doc_id", "left")


def identity_edges(spark, sf_dir):
    """A declared name that differs from the visible one: looks alike, is another, or is the same."""
    name = F.trim(F.regexp_extract("text", r"^[A-Za-z ]*", 0))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), name, F.lit("\t")).alias("visible"), F.when(F.col("doc_id") % 3 == 0, name).when(F.col("doc_id") % 3 == 1, F.translate(name, "o", "о")).otherwise(F.concat(name, F.lit("x"))).alias("expected_identity"))
    return assurance.identity_edges(rows, _table_of(spark)).select("doc_id", "boundary", "materiality", "reason")


def observer_edges(spark, sf_dir):
    """Edges of what other observers saw: another model input, nodes that a browser hides, and hidden texts with a finding."""
    rows = _analyzed(spark, sf_dir)
    k = F.col("doc_id") % 10
    model = assurance.model_edges(rows.select("doc_id", "text", F.when(k == 0, F.concat("text", F.lit("!"))).when(k == 1, F.col("text")).alias("model_text")))
    nodes = F.array(F.struct((k != 3).alias("visible"), F.when(k == 3, "x").otherwise(" ").alias("text")), F.struct(F.lit(False).alias("visible"), F.lit("\u2003\n").alias("text")))
    browser = assurance.browser_edges(rows.select("doc_id", nodes.alias("nodes")))
    hidden = assurance.hidden_edges(rows.select("doc_id", F.col("hidden.tag_payloads").alias("texts")), detect.exploded(rows, F.col("findings")))
    return model.unionByName(browser).unionByName(hidden).select("doc_id", "boundary", "materiality", _joined("finding_ids"))


def claim_edges(spark, sf_dir):
    k = F.col("doc_id") % 5
    part = F.substring("text", 1, 3)
    span = F.struct(F.lit("machine").alias("view"), F.lit(0).alias("start"), F.when(k == 3, 1 << 30).otherwise(3).alias("end"), F.when(k == 1, "zzzz").when(k == 2, part).alias("text"), F.when(k == 4, T.sha256(part)).alias("sha256"))
    docs = _table(spark, sf_dir, "documents")
    claims = docs.select("doc_id", F.lit("identity").alias("boundary"), F.lit("material").alias("materiality"), F.array(span).alias("evidence"), F.lit("as seen").alias("explanation"))
    checked = assurance.valid_claims(claims, docs.select("doc_id", F.col("text").alias("machine"), F.col("text").alias("human")))
    return assurance.claim_edges(checked).select("doc_id", "boundary", "materiality")


def assurance_rollup(spark, sf_dir):
    """Radial edges and edges of another model input together, attached to the summary; with the channels observed."""
    k = F.col("doc_id") % 10
    rows = _analyzed(spark, sf_dir, max_chars=5_000).withColumn("model_text", F.when(k == 0, F.concat("text", F.lit("!"))))
    rolled = assurance.rollup(rows, [assurance.radial_edges(rows), assurance.model_edges(rows.filter("status = 'admitted'"))])
    out = assurance.attached(rows, rolled)
    return out.select("doc_id", "assurance.disposition", "assurance.material", "assurance.edges", F.col("summary.material_divergence").alias("summary_material"), F.col("assurance.coverage.model_input").alias("model_input"), F.col("assurance.coverage.hidden").alias("hidden"))


def request_boundary(spark, sf_dir):
    k = F.col("doc_id") % 8
    name = F.concat(F.lit('"'), F.coalesce("lang", F.lit("und")), F.lit('"'))
    sent = F.when(k == 0, F.concat(F.lit('{"text":'), name, F.lit("}"))).when(k == 1, F.lit('{"text":5}')).when(k == 2, F.concat(F.lit('{"provenance":[],"text":'), name, F.lit("}")))
    sent = sent.when(k == 3, F.lit("[1]")).when(k == 4, F.concat(F.lit('{"browser":true,"text":'), name, F.lit("}"))).when(k == 5, F.concat(F.lit('{"browser":true,"content_type":"TEXT/HTML; x","provenance":{"a":1},"text":'), name, F.lit("}")))
    sent = sent.when(k == 6, F.concat(F.lit('{"browser":1,"text":'), name, F.lit("}"))).otherwise(F.concat(F.lit('{"content_type":"'), F.repeat(F.lit("x"), 201), F.lit('","text":'), name, F.lit("}")))
    rows = readers.requests(_table(spark, sf_dir, "documents").select("doc_id", sent.alias("request")))
    return rows.select("doc_id", "text", "content_type", "provenance", "status", F.coalesce("reason", F.lit("")).alias("reason"))


def acquired_formats(spark, sf_dir):
    """Bytes under different names: texts, an unknown type, bytes with zeros, no UTF-8, and a broken document."""
    k = F.col("doc_id") % 6
    raw = F.encode("text", "UTF-8")
    content = F.when(k == 2, F.concat(F.unhex(F.lit("0000")), raw)).when(k == 3, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    name = F.when(k == 0, "a.TXT").when(k == 1, "a.json").when(k == 2, "a.bin").when(k == 3, "a.html").when(k == 4, "a.docx").otherwise("a")
    rows = _table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), name.alias("filename"))
    out = readers.acquired(rows.withColumn("content_type", readers.content_type(F.col("filename"), content=F.col("content"))))
    reason = F.when(k == 4, F.split("reason", ":")[0]).otherwise(F.coalesce("reason", F.lit("")))
    return out.select("doc_id", "status", reason.alias("reason"), T.sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"), "source_bytes")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with hidden markup for two of three remainders: doc_id, text and the struct html."""
    added = F.when(F.col("page_id") % 3 == 1, '<div hidden>secret</div></body>').when(F.col("page_id") % 3 == 2, '<input type="hidden" value="v"></body>').otherwise("</body>")
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.replace(F.col("html"), F.lit("</body>"), added).alias("text"), F.lit("Text/HTML; charset=utf-8").alias("content_type"))
    return html.inspect(rows.filter(html.is_html(F.col("content_type"))).drop("content_type"))


def html_comments(spark, sf_dir):
    rows = pages(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("page_id"), F.size("html.comments").alias("comments"), F.size(F.filter("html.hidden", lambda x: x["text"] == "secret")).alias("secrets"), F.size("html.attrs").alias("attributes"))


def html_visibility(spark, sf_dir):
    rows = pages(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("page_id"), T.sha256(F.col("html.visible")).alias("visible_sha256"), F.size("html.hidden").alias("hidden"), F.size("html.non_rendered").alias("non_rendered"), F.array_join("html.selectors", ",").alias("selectors"))


def html_fragments(spark, sf_dir):
    rows = html.fragments(pages(spark, sf_dir))
    return rows.groupBy("kind", "reason", "tag").agg(F.count("*").alias("n"))


def html_findings(spark, sf_dir):
    return detect.html_findings(pages(spark, sf_dir)).select(F.col("doc_id").alias("page_id"), "id", "category", "severity", "materiality")


def page_edges(spark, sf_dir):
    """Pages whose browser shows the same text, or another."""
    rows = pages(spark, sf_dir).withColumn("browser_text", F.concat("html.visible", F.when(F.col("doc_id") % 2 == 0, "!").otherwise("")))
    out = analysis.analyzed(rows, {}, max_chars=1 << 30, max_bytes=1 << 30).select("doc_id", F.explode_outer("edges").alias("e")).filter("e IS NOT NULL").select("doc_id", "e.*").filter("boundary = 'rendering'")
    return out.select(F.col("doc_id").alias("page_id"), "relation", "materiality", F.array_join("evidence_categories", ",").alias("categories"))


def stream_reassembly(spark, sf_dir):
    """Chunks of 1,000 bytes; of some documents one comes twice, of some the second is missing, of some it comes twice and differs."""
    rows = evidence(spark, sf_dir).withColumn("content", F.encode("text", "UTF-8"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 1000).cast("int")))
    k = F.col("doc_id") % 10
    chunks = rows.filter("length(content) > 0").select("doc_id", "content", at.alias("seq")).select("doc_id", "seq", F.substr("content", F.col("seq") * 1000 + 1, F.lit(1000)).alias("chunk"), (F.length("content") <= F.col("seq") * 1000 + 1000).alias("last"))
    chunks = chunks.filter(~((k == 2) & (F.col("seq") == 1)))
    again = chunks.filter((k == 1) & (F.col("seq") == 0)).unionByName(chunks.filter((k == 3) & (F.col("seq") == 0)).withColumn("chunk", F.unhex(F.lit("41"))))
    out = readers.reassembled(chunks.unionByName(again), 16_000_000)
    return out.filter(k != 2).select("doc_id", F.when(F.col("complete"), F.col("byte_length")).alias("byte_length"), F.col("source_sha256").alias("sha256"), "complete").unionByName(out.filter(k == 2).select("doc_id", F.lit(None).cast("long").alias("byte_length"), F.lit(None).cast("string").alias("sha256"), "complete"))


def receipts(spark, sf_dir):
    rows = _analyzed(spark, sf_dir)
    body = F.to_json(F.struct(reports.given(F.col("text")).alias("input"), "summary"))
    rows = rows.select("doc_id", integrity.with_receipt(body).alias("report"))
    rows = rows.withColumn("tampered", F.replace("report", F.lit('"finding_count":'), F.lit('"finding_count":1')))
    return rows.select("doc_id", reports.receipt_of(F.col("report")).alias("receipt"), integrity.verified("report").alias("verified"), integrity.verified("tampered").alias("tampered_verified"))


def bundles(spark, sf_dir):
    """Bundles of a report and its bytes: read back whole, and as the bundle of other bytes."""
    rows = evidence(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("source"), integrity.with_receipt(F.to_json(F.struct(reports.given(F.col("text")).alias("input")))).alias("report"))
    rows = rows.withColumn("bundle", integrity.bundled("report", "source"))
    return rows.select("doc_id", integrity.bundle_holds("bundle").alias("holds"), integrity.bundle_holds(F.concat(F.substring("bundle", 1, 40), F.unhex(F.lit("00")), F.expr("substring(bundle, 42)"))).alias("changed_holds"))


_NAMES = [human_projection, raw_views, tag_stripped, compact_skeleton, invisible_findings, bidi_findings, carrier_patterns, tag_runs, emoji_zwj, normalization_nfc, normalization_delta, confusable_findings, confusable_skeleton, script_families, character_names, lookalike_pairs, view_divergence]
_NAMES += [analysis_budgets, radial_edges, radial_rollup, document_summary, category_groups, hidden_projection, semantic_view, overridden_lookalikes, sarif_locations, sarif_runs, text_reports, budget_rejects, lexical_units, invalid_utf8, model_tokens, identity_edges, observer_edges, claim_edges, assurance_rollup]
_NAMES += [request_boundary, acquired_formats, html_comments, html_visibility, html_fragments, html_findings, page_edges, stream_reassembly, receipts, bundles]
QUERIES = {f.__name__: f for f in _NAMES}

_INVISIBLE = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
_TAGS, _RUN = r"[\x{E0000}-\x{E007F}]", r"[\x{E0000}-\x{E007E}]*\x{E007F}|[\x{E0000}-\x{E007E}]+"
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_CHARS = f"""{_DOCS}, c AS (SELECT doc_id, text, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS idx FROM d WHERE regexp_matches(text, '{_INVISIBLE}')),
i AS (SELECT doc_id, text, idx, unicode(ch) AS cp, unicode(ch) = 8205 AND unicode(substr(text, idx, 1)) BETWEEN 126976 AND 129791 AND unicode(substr(text, idx + 2, 1)) BETWEEN 126976 AND 129791 AS emoji_context FROM c WHERE regexp_matches(ch, '{_INVISIBLE}')),
f1 AS (SELECT doc_id, 'unicode-invisible:' || idx AS id, 'invisible-unicode' AS category, idx AS "start", idx + 1 AS "end", cp, emoji_context, text,
  CASE WHEN emoji_context THEN 0 WHEN cp BETWEEN 917504 AND 917631 THEN 2 WHEN cp BETWEEN 8234 AND 8238 OR cp BETWEEN 8294 AND 8297 THEN 3 ELSE 2 END AS sev,
  CASE WHEN emoji_context OR cp BETWEEN 917504 AND 917631 THEN 1 WHEN cp BETWEEN 8234 AND 8238 OR cp BETWEEN 8294 AND 8297 THEN 3 ELSE 2 END AS mat FROM i),
f2 AS (SELECT doc_id, 'bidi-control:' || idx AS id, 'bidi-reordering' AS category, idx AS "start", idx + 1 AS "end", CASE WHEN cp IN (8206, 8207, 1564) THEN 2 ELSE 3 END AS sev, CASE WHEN cp IN (8206, 8207, 1564) THEN 2 ELSE 3 END AS mat
  FROM i WHERE cp IN (8206, 8207, 1564) OR cp BETWEEN 8234 AND 8238 OR cp BETWEEN 8294 AND 8297)"""
_SEV = "['info','low','medium','high']"
_MAT = "['none','context-dependent','potentially-material','material']"
_RUNS = f"""{_DOCS}, t AS (SELECT doc_id, 0 AS n, length(text) - length(regexp_extract(text, '{_RUN}')) AS "start", length(text) AS "end", regexp_extract(text, '{_RUN}') AS run FROM d WHERE regexp_matches(text, '{_TAGS}')),
r AS (SELECT doc_id, n, "start", "end", list_aggregate(list_transform(list_filter(string_split(run, ''), lambda x: unicode(x) BETWEEN 917536 AND 917630), lambda x: chr(unicode(x) - 917504)), 'string_agg', '') AS decoded, unicode(right(run, 1)) = 917631 AS terminated,
  CASE WHEN doc_id % 10 = 5 THEN 'unicode-tag-sequence' ELSE 'ascii-smuggling' END AS category FROM t)"""
_MIXED = f"regexp_matches(text, '{_LATIN}') AND contains(text, chr(1086))"
_FOUND = f"""{_CHARS}, f AS (SELECT doc_id, id, category, "start", "end", sev, mat FROM f1 UNION ALL SELECT * FROM f2
UNION ALL SELECT doc_id, 'hidden-carrier-pattern', 'watermark-like-hidden-text', NULL, NULL, 1, 1 FROM d WHERE length(text) - length(replace(text, chr(8203), '')) >= 4
UNION ALL SELECT doc_id, 'unicode-tags:0', CASE doc_id % 10 WHEN 4 THEN 'ascii-smuggling' ELSE 'unicode-tag-sequence' END, length(text) - CASE doc_id % 10 WHEN 4 THEN 2 ELSE 6 END, length(text), CASE doc_id % 10 WHEN 4 THEN 3 ELSE 0 END, CASE doc_id % 10 WHEN 4 THEN 3 ELSE 1 END FROM d WHERE doc_id % 10 IN (4, 5)
UNION ALL SELECT doc_id, 'normalization-delta', 'normalization', NULL, NULL, 2, 3 FROM d WHERE contains(text, chr(65313))
UNION ALL SELECT doc_id, 'confusable-skeleton', 'confusable-homoglyph', NULL, NULL, CASE WHEN {_MIXED} THEN 3 ELSE 1 END, CASE WHEN {_MIXED} THEN 2 ELSE 1 END FROM d WHERE contains(text, chr(1086)) OR contains(text, chr(65313)))"""


def _ends(name: str, source: str, pairs: list[tuple[str, str]]) -> str:
    """Common prefix and suffix of pairs (left, right) of columns of a table with doc_id."""
    some = " UNION ALL ".join(f"""SELECT doc_id, '{a}' AS "left", '{b}' AS "right", {a} AS a, {b} AS b FROM {source}""" for a, b in pairs)
    return f"""p_{name} AS ({some}),
q_{name} AS (SELECT *, a = b AS same, CASE WHEN a = b THEN length(a) ELSE coalesce(list_min(list_filter(range(least(length(a), length(b))), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1))), least(length(a), length(b))) END AS prefix FROM p_{name}),
{name} AS (SELECT *, CASE WHEN same THEN 0 ELSE coalesce(list_min(list_filter(range(least(length(a), length(b)) - prefix), lambda i: substr(a, length(a) - i, 1) <> substr(b, length(b) - i, 1))), least(length(a), length(b)) - prefix) END AS suffix FROM q_{name})"""


_VIEWS = f"""v AS (SELECT doc_id, text AS machine, regexp_replace(text, '{_INVISIBLE}', '', 'g') AS human_projection, regexp_replace(text, '{_TAGS}', '', 'g') AS tag_stripped FROM d)"""
_SHOWN = _ends("s", "v", [("human_projection", "machine"), ("human_projection", "tag_stripped"), ("machine", "tag_stripped")])


def _cut(t: str) -> str:
    n = f"(length({t}) - suffix - prefix)"
    return f"CASE WHEN same THEN NULL WHEN {n} <= 96 THEN substr({t}, prefix + 1, {n}) ELSE substr({t}, prefix + 1, 48) || chr(8230) || substr({t}, length({t}) - suffix - 47, 48) END"


_EDGES = f"""{_FOUND}, {_VIEWS}, {_ends("s", "v", [("human_projection", "machine"), ("machine", "tag_stripped")])},
x AS (SELECT doc_id, CASE "left" WHEN 'machine' THEN 'hidden-tag' ELSE 'visibility' END AS boundary, NOT same AS differs, prefix, length(CASE "left" WHEN 'machine' THEN a ELSE b END) - suffix AS upto FROM s
UNION ALL SELECT doc_id, 'normalization', contains(text, chr(65313)), NULL, NULL FROM d
UNION ALL SELECT doc_id, 'identity', regexp_matches(text, '[0-1Im|"%`éóèñüçäöêíÉÈÑÓÇÊÜÖÄÍоＡ]'), NULL, NULL FROM d),
w(boundary, category) AS (VALUES ('visibility', 'ascii-smuggling'), ('visibility', 'bidi-reordering'), ('visibility', 'hidden-html-css'), ('visibility', 'invisible-unicode'), ('hidden-tag', 'ascii-smuggling'), ('hidden-tag', 'unicode-tag-sequence'), ('normalization', 'normalization'), ('identity', 'confusable-homoglyph')),
z AS (SELECT f.*, w.boundary FROM f JOIN w USING (category)),
y AS (SELECT x.doc_id, x.boundary, x.differs, z.id, z.category, z.mat FROM x LEFT JOIN z ON z.doc_id = x.doc_id AND z.boundary = x.boundary AND (NOT x.differs OR z."start" IS NULL OR x.prefix IS NULL OR (z."start" < x.upto AND z."end" > x.prefix))),
e AS (SELECT doc_id, boundary, CASE WHEN differs THEN 'divergence' ELSE 'agreement' END AS relation, CASE WHEN NOT differs THEN 0 ELSE greatest(1, coalesce(max(mat), 0)) END AS m,
coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories, coalesce(string_agg(id, ',' ORDER BY id), '') AS finding_ids FROM y GROUP BY doc_id, boundary, differs)"""
_SUMS = f"""{_FOUND}, u AS (SELECT d.doc_id, any_value(d.text) AS text, count(f.id) AS n, {_SEV}[coalesce(max(sev), 0) + 1] AS severity, coalesce(bool_or(mat >= 2), false) AS material, coalesce(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), []) AS categories, coalesce(list_sort(list(DISTINCT category) FILTER (mat >= 2)), []) AS basis, arg_min(category, id) AS first_category FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id)"""
_PAGE = """WITH p AS (SELECT page_id, replace(html, '</body>', CASE page_id % 3 WHEN 1 THEN '<div hidden>secret</div></body>' WHEN 2 THEN '<input type="hidden" value="v"></body>' ELSE '</body>' END) AS html FROM pages)"""
_SEEN = """replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<div hidden>secret</div>', '', 'g'), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')"""
_NONE = "NULL::VARCHAR"

SQL = {
    "human_projection": f"{_DOCS} SELECT doc_id, length(v) AS visible_len, sha256(v) AS visible_sha256 FROM (SELECT doc_id, regexp_replace(text, '{_INVISIBLE}', '', 'g') AS v FROM d)",
    "raw_views": f"{_DOCS} SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, sha256(text) AS sha256, md5(lower(hex(encode(text)))) AS hex_md5 FROM d",
    "tag_stripped": f"{_DOCS} SELECT doc_id, length(v) AS len, sha256(v) AS sha256 FROM (SELECT doc_id, regexp_replace(text, '{_TAGS}', '', 'g') AS v FROM d)",
    "compact_skeleton": f"{_DOCS} SELECT doc_id, sha256(translate(text, 'оＡ', 'oA')) AS skeleton_sha256 FROM d",
    "invisible_findings": f"""{_CHARS} SELECT doc_id, "start" AS idx, printf('U+%04X', cp) AS codepoint, {_SEV}[sev + 1] AS severity, {_MAT}[mat + 1] AS materiality FROM f1""",
    "bidi_findings": f"""{_CHARS} SELECT doc_id, "start" AS idx, CASE sev WHEN 3 THEN 'strong' ELSE 'mark' END AS strength, {_SEV}[sev + 1] AS severity, {_MAT}[mat + 1] AS materiality FROM f2""",
    "carrier_patterns": f"{_DOCS} SELECT doc_id, count(*) AS carriers, count(DISTINCT ch) AS distinct_carriers, count(*) >= 4 AND (count(*) / any_value(n) >= 0.05 OR count(DISTINCT ch) <= greatest(2, count(*) // 2)) AS suspicious FROM (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS ch FROM d) WHERE unicode(ch) IN (8203, 8204, 8205, 8288, 65279, 847) OR unicode(ch) BETWEEN 65024 AND 65039 OR unicode(ch) BETWEEN 917760 AND 917999 GROUP BY doc_id",
    "tag_runs": f"{_RUNS} SELECT * FROM r",
    "emoji_zwj": f"""{_CHARS} SELECT doc_id, "start" AS idx, emoji_context FROM f1 WHERE cp = 8205""",
    "normalization_nfc": f"{_DOCS} SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256, nfc_normalize(text) <> text AS changed FROM d",
    "normalization_delta": f"{_DOCS} SELECT doc_id, sha256(replace(text, chr(65313), 'A')) AS nfkc_sha256, 'material' AS materiality FROM d WHERE contains(text, chr(65313))",
    "confusable_findings": f"{_DOCS} SELECT doc_id, length(text) - length(translate(text, 'оＡ', '')) AS n_positions, length(regexp_extract(text, '^[^оＡ]*')) AS first_position, concat_ws(',', CASE WHEN contains(text, 'о') THEN 'Cyrillic' END, CASE WHEN regexp_matches(text, '{_LATIN}') THEN 'Latin' END, CASE WHEN contains(text, 'Ａ') THEN 'Other' END) AS scripts, {_MIXED} AS mixed FROM d WHERE regexp_matches(text, '[оＡ]')",
    "confusable_skeleton": f"""{_DOCS} SELECT doc_id, sha256(replace(replace(replace(translate(replace(replace(replace(text, '`', chr(39)), 'ç', 'c' || chr(806)), 'Ç', 'C' || chr(806)), '01I|оＡÍ', 'OllloAĺ'), 'm', 'rn'), '"', chr(39) || chr(39)), '%', 'º/₀')) AS skeleton_sha256 FROM d""",
    "script_families": f"{_DOCS} SELECT doc_id, concat_ws(',', CASE WHEN contains(text, 'о') THEN 'Cyrillic' END, CASE WHEN regexp_matches(text, '{_LATIN}') THEN 'Latin' END, CASE WHEN contains(text, 'Ａ') THEN 'Other' END) AS scripts FROM d",
    "character_names": f"""{_CHARS}, k(cp, bidi, name) AS (VALUES (8203, 'BN', 'ZERO WIDTH SPACE'), (8205, 'BN', 'ZERO WIDTH JOINER'), (8206, 'L', 'LEFT-TO-RIGHT MARK'), (8238, 'RLO', 'RIGHT-TO-LEFT OVERRIDE'), (917576, 'BN', 'TAG LATIN CAPITAL LETTER H'), (917577, 'BN', 'TAG LATIN CAPITAL LETTER I'), (917607, 'BN', 'TAG LATIN SMALL LETTER G'), (917602, 'BN', 'TAG LATIN SMALL LETTER B'), (917605, 'BN', 'TAG LATIN SMALL LETTER E'), (917614, 'BN', 'TAG LATIN SMALL LETTER N'), (917631, 'BN', 'CANCEL TAG'))
SELECT i.cp, 'Cf' AS category, k.bidi, k.name, '' AS script, count(*) AS n FROM i LEFT JOIN k USING (cp) GROUP BY ALL""",
    "lookalike_pairs": f"{_DOCS}, t AS (SELECT * FROM d UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 10 = 6), k AS (SELECT doc_id, text, translate(text, 'оＡ', 'oA') AS s FROM t), m AS (SELECT s, min(doc_id) AS doc_id_a FROM k GROUP BY s) SELECT doc_id_a, k.doc_id AS doc_id_b FROM k JOIN m USING (s) JOIN k AS o ON o.doc_id = doc_id_a WHERE o.text <> k.text",
    "view_divergence": f"""{_DOCS}, {_VIEWS}, {_SHOWN} SELECT doc_id, "left", "right", CASE WHEN same THEN 'agreement' ELSE 'divergence' END AS relation, prefix, suffix, CASE WHEN NOT same THEN prefix END AS first_difference, length(b) - length(a) AS length_delta, sha256(a) AS left_sha256, sha256(b) AS right_sha256, length(a) AS left_length, length(b) AS right_length, {_cut("a")} AS left_fragment, {_cut("b")} AS right_fragment FROM s""",
    "analysis_budgets": f"{_EDGES}, g AS (SELECT doc_id, max(m) >= 2 AS material FROM e GROUP BY doc_id), n AS (SELECT d.doc_id, any_value(length(text) > 5000 OR strlen(text) > 256000) AS large, count(f.id) AS c FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id) SELECT doc_id, CASE WHEN large OR c > 4 THEN 'rejected' ELSE 'admitted' END AS status, CASE WHEN large THEN 'full-evidence analysis limit exceeded' WHEN c > 4 THEN 'finding budget exceeded' ELSE '' END AS reason, CASE WHEN NOT large AND c <= 4 THEN c END AS finding_count, CASE WHEN NOT large AND c <= 4 THEN material END AS material FROM n JOIN g USING (doc_id)",
    "radial_edges": f"{_EDGES} SELECT doc_id, boundary, relation, {_MAT}[m + 1] AS materiality, categories, finding_ids FROM e",
    "radial_rollup": f"{_EDGES} SELECT doc_id, {_MAT}[max(m) + 1] AS disposition, max(m) >= 2 AS material, count(*) FILTER (relation = 'divergence') AS divergent, count(*) FILTER (relation = 'agreement') AS agreeing, count(*) FILTER (m >= 2) AS promoted, coalesce(string_agg(boundary, ',' ORDER BY boundary) FILTER (relation = 'divergence'), '') AS boundaries FROM e GROUP BY doc_id",
    "document_summary": f"{_SUMS} SELECT doc_id, n AS finding_count, severity, material AS material_divergence, array_to_string(categories, ',') AS categories FROM u",
    "category_groups": f"{_FOUND} SELECT doc_id, category, count(*) AS n, {_MAT}[max(mat) + 1] AS materiality, string_agg(id, ',' ORDER BY id) AS ids FROM f GROUP BY doc_id, category",
    "hidden_projection": f"{_CHARS}, n AS (SELECT doc_id, count(*) AS c, arg_min(printf('U+%04X', cp), id) AS u FROM f1 GROUP BY doc_id) SELECT d.doc_id, CASE doc_id % 10 WHEN 4 THEN 'HI' WHEN 5 THEN 'gbeng' ELSE '' END AS payloads, coalesce(c, 0) AS invisible, u AS first_codepoint FROM d LEFT JOIN n USING (doc_id)",
    "semantic_view": f"{_SUMS} SELECT doc_id, sha256(regexp_replace(text, '{_INVISIBLE}', '', 'g')) AS visible_sha256, CASE doc_id % 10 WHEN 4 THEN 'HI' WHEN 5 THEN 'gbeng' ELSE '' END AS decoded_hidden_text, material AS material_divergence, array_to_string(basis, ',') AS basis FROM u",
    "overridden_lookalikes": f"{_DOCS} SELECT doc_id, CASE WHEN {_MIXED} THEN 'high' ELSE 'low' END AS severity, length(text) - length(translate(text, 'éＡ', '')) AS n FROM d WHERE regexp_matches(text, '[éＡ]')",
    "sarif_locations": f"""{_CHARS}, z AS (SELECT doc_id, id, sev, substr(text, 1, "start") AS a, substr(text, 1, "end") AS b FROM f1) SELECT doc_id, id AS finding_id, CASE WHEN sev >= 3 THEN 'error' WHEN sev = 2 THEN 'warning' ELSE 'note' END AS level, length(a) - length(replace(a, chr(10), '')) + 1 AS start_line, length(string_split(a, chr(10))[-1]) + 1 AS start_col, length(b) - length(replace(b, chr(10), '')) + 1 AS end_line, length(string_split(b, chr(10))[-1]) + 1 AS end_col FROM z""",
    "sarif_runs": f"""{_SUMS} SELECT doc_id, n AS results, '[' || array_to_string(list_transform(categories, lambda c: '{{"id":"' || c || '"}}'), ',') || ']' AS rules, CASE first_category WHEN 'bidi-reordering' THEN 'A control that changes the order in which text is displayed.' WHEN 'confusable-homoglyph' THEN 'Characters that look like others.' WHEN 'watermark-like-hidden-text' THEN 'Invisible characters repeat or crowd like a hidden mark.' WHEN 'normalization' THEN 'The text changes when it is normalised.' WHEN 'invisible-unicode' THEN 'A character that is not displayed, or changes how others are.' ELSE '' END AS message FROM u""",
    "text_reports": f"{_SUMS} SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'No verdict: full-evidence analysis limit exceeded' ELSE 'Schema: veilscope.report.v1' END AS line_1, CASE WHEN length(text) <= 5000 THEN 'Severity: ' || upper(severity) END AS line_2, CASE WHEN length(text) <= 5000 THEN 'Material divergence: ' || CASE WHEN material THEN 'YES' ELSE 'NO' END END AS line_3 FROM u",
    "budget_rejects": f"{_DOCS} SELECT doc_id, CASE WHEN length(text) > 5000 OR strlen(text) > 256000 THEN 'rejected' ELSE 'admitted' END AS status, CASE WHEN length(text) > 5000 OR strlen(text) > 256000 THEN 'full-evidence analysis limit exceeded' ELSE '' END AS reason FROM d",
    "lexical_units": "SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z_À-ÖØ-öø-ÿ]+|[^0-9A-Za-z_À-ÖØ-öø-ÿ\\s]')) AS token_count FROM documents",
    "invalid_utf8": f"""{_DOCS} SELECT doc_id, strlen(text) AS "start", strlen(text) + 1 AS "end", 'ff' AS detail, 'high' AS severity FROM d WHERE doc_id % 10 < 3""",
    "model_tokens": f"{_DOCS}, t AS (SELECT doc_id, text, regexp_replace(text, '{_INVISIBLE}', '', 'g') AS v FROM (SELECT doc_id, CASE WHEN length(text) <= 64000 AND strlen(text) <= 256000 THEN text END AS text FROM d)) SELECT doc_id, text = v AS equal, len(string_split(text, ' ')) - len(string_split(v, ' ')) AS token_count_delta, CASE WHEN text <> v THEN 'context-dependent' END AS materiality FROM t",
    "identity_edges": "WITH t AS (SELECT doc_id, trim(regexp_extract(text, '^[A-Za-z ]*')) AS n FROM documents) SELECT doc_id, 'identity' AS boundary, CASE doc_id % 3 WHEN 1 THEN 'potentially-material' ELSE 'context-dependent' END AS materiality, 'declared-identity-mismatch' AS reason FROM t WHERE doc_id % 3 = 2 OR (doc_id % 3 = 1 AND contains(n, 'o'))",
    "observer_edges": f"{_DOCS} SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'model-input' WHEN 3 THEN 'rendered-hidden-content' ELSE 'hidden-content' END AS boundary, 'potentially-material' AS materiality, CASE doc_id % 10 WHEN 4 THEN 'unicode-tags:0' ELSE '' END AS finding_ids FROM d WHERE doc_id % 10 IN (0, 3, 4)",
    "claim_edges": "SELECT doc_id, 'identity' AS boundary, 'material' AS materiality FROM documents WHERE length(text) >= 3 AND doc_id % 5 NOT IN (1, 3)",
    "assurance_rollup": f"{_EDGES}, g AS (SELECT doc_id, max(m) AS m, count(*) FILTER (relation = 'divergence') AS c FROM e GROUP BY doc_id), o AS (SELECT d.doc_id, length(text) <= 5000 AS here, CASE WHEN doc_id % 10 = 0 THEN greatest(m, 2) ELSE m END AS m, c + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS c, coalesce((SELECT max(mat) FROM f WHERE f.doc_id = d.doc_id) >= 2, false) AS own FROM d JOIN g USING (doc_id)) SELECT doc_id, CASE WHEN here THEN {_MAT}[m + 1] ELSE 'unavailable' END AS disposition, CASE WHEN here THEN m >= 2 END AS material, CASE WHEN here THEN c ELSE 0 END AS edges, CASE WHEN here THEN own OR m >= 2 END AS summary_material, CASE WHEN doc_id % 10 = 0 THEN 'available' ELSE 'unavailable' END AS model_input, CASE WHEN here THEN 'available' ELSE 'unavailable' END AS hidden FROM o",
    "request_boundary": f"""SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 5) THEN coalesce(lang, 'und') END AS text, CASE doc_id % 8 WHEN 0 THEN 'text/plain' WHEN 5 THEN 'TEXT/HTML; x' END AS content_type, CASE WHEN doc_id % 8 = 5 THEN '{{"a":1}}' END AS provenance, CASE WHEN doc_id % 8 IN (0, 5) THEN 'admitted' ELSE 'rejected' END AS status, ['', 'text is no string', 'provenance is no object', 'not an object', 'a browser needs HTML', '', 'browser is no boolean', 'content_type is no short string'][doc_id % 8 + 1] AS reason FROM documents""",
    "acquired_formats": """SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN 'admitted' WHEN doc_id % 6 = 3 THEN 'undecodable' ELSE 'rejected' END AS status, ['', '', 'binary', 'invalid-utf8', 'BadZipFile', 'unsupported format'][doc_id % 6 + 1] AS reason, sha256(CASE WHEN doc_id % 6 IN (0, 1) THEN text ELSE '' END) AS text_sha256, strlen(text) + CASE doc_id % 6 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS source_bytes FROM documents""",
    "html_comments": _PAGE + """ SELECT page_id, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS comments, contains(html, '<div hidden>secret')::INT AS secrets, contains(html, '<input type="hidden" value="v">')::INT AS attributes FROM p""",
    "html_visibility": _PAGE + f""" SELECT page_id, sha256({_SEEN}) AS visible_sha256, contains(html, '<div hidden>secret')::INT AS hidden, len(regexp_extract_all(html, '(?s)<(?:style|script)[^>]*>.*?\\S.*?</')) AS non_rendered, '' AS selectors FROM p""",
    "html_fragments": _PAGE + """, n AS (SELECT contains(html, '<div hidden>secret') AS h, len(regexp_extract_all(html, '(?s)<style[^>]*>.*?</style>')) AS s, len(regexp_extract_all(html, '(?s)<script[^>]*>.*?</script>')) AS j FROM p) SELECT 'hidden' AS kind, 'hidden-attribute' AS reason, 'div' AS tag, count(*) FILTER (h) AS n FROM n UNION ALL SELECT 'non_rendered', 'non-rendered-style', 'style', sum(s) FROM n UNION ALL SELECT 'non_rendered', 'non-rendered-script', 'script', sum(j) FROM n""",
    "html_findings": _PAGE + """ SELECT page_id, 'html-hidden-content' AS id, 'hidden-html-css' AS category, 'high' AS severity, 'material' AS materiality FROM p WHERE contains(html, '<div hidden>secret') OR contains(html, '<input type="hidden" value="v">') UNION ALL SELECT page_id, 'html-comments', 'non-rendered-html', 'low', 'context-dependent' FROM p WHERE contains(html, '<!--')""",
    "page_edges": _PAGE + """, o AS (SELECT page_id, contains(html, '<div hidden>secret') OR contains(html, '<input type="hidden" value="v">') AS h FROM p) SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'divergence' ELSE 'agreement' END AS relation, CASE WHEN page_id % 2 = 1 THEN 'none' WHEN NOT h THEN 'potentially-material' ELSE 'material' END AS materiality, concat_ws(',', CASE WHEN h THEN 'hidden-html-css' END, CASE WHEN page_id % 2 = 0 THEN 'render-observer-divergence' END) AS categories FROM o""",
    "stream_reassembly": f"{_DOCS} SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (2, 3) THEN strlen(text) END AS byte_length, CASE WHEN doc_id % 10 NOT IN (2, 3) THEN sha256(text) END AS sha256, doc_id % 10 <> 3 AND (doc_id % 10 <> 2 OR strlen(text) <= 1000) AS complete FROM d WHERE length(text) > 0",
    "receipts": f"""{_SUMS}, j AS (SELECT doc_id, '{{"input":{{"byte_length":' || strlen(text) || ',"char_length":' || length(text) || ',"sha256":"' || sha256(text) || '"}},"summary":{{"categories":[' || array_to_string(list_transform(categories, lambda c: '"' || c || '"'), ',') || '],"finding_count":' || n || ',"material_divergence":' || material || ',"severity":"' || severity || '"}}}}' AS body FROM u) SELECT doc_id, sha256(body) AS receipt, true AS verified, false AS tampered_verified FROM j""",
    "bundles": f"{_DOCS} SELECT doc_id, true AS holds, false AS changed_holds FROM d",
}
