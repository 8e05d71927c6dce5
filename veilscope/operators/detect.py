"""Detectors: a text to an array of findings inside its row, so that a document is read once and nothing is shuffled.

A finding is id, category, severity, materiality, start, end, detail, explanation, evidence (JSON). Every detector
looks for its characters with a pattern first; only texts that have some are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode_tables as U

SEVERITY = ["info", "low", "medium", "high", "critical"]
MATERIALITY = ["none", "context-dependent", "potentially-material", "material"]
FIELDS = ["id", "category", "severity", "materiality", "start", "end", "detail", "explanation", "evidence"]
COLUMNS = ["doc_id", *FIELDS]
FINDINGS = "array<struct<id:string,category:string,severity:string,materiality:string,start:int,end:int,detail:string,explanation:string,evidence:string>>"
#: Budgets of a document; one that exceeds them is rejected, never reported as clean.
MAX_CHARS, MAX_BYTES, MAX_FINDINGS = 64_000, 256_000, 10_000
#: Fragments, comments or spans that a finding's evidence lists.
MAX_EVIDENCE = 100
EXPLAINED = {
    "invisible-unicode": "A character that is not displayed, or changes how others are.",
    "bidi-reordering": "A control that changes the order in which text is displayed.",
    "watermark-like-hidden-text": "Invisible characters repeat or crowd like a hidden mark.",
    "unicode-tag-sequence": "Tag characters that end a known flag.",
    "ascii-smuggling": "Tag characters that spell text which is not displayed.",
    "normalization": "The text changes when it is normalised.",
    "confusable-homoglyph": "Characters that look like others.",
    "hidden-html-css": "Page content that markup or style hides.",
    "non-rendered-html": "Comments, which are never displayed.",
    "render-observer-divergence": "A browser shows other text than the markup says.",
    "invalid-utf8": "Bytes that are no text.",
}


def level(name: Column, order: list[str]) -> Column:
    """Position in an ordered enumeration, which a rollup takes the maximum of."""
    return F.array_position(F.array(*map(F.lit, order)), name).cast("int") - 1


def named(place: Column, order: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, order)), F.coalesce(place, F.lit(0)))


def admitted(docs: DataFrame, max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with status and reason: `rejected` where the text is over a budget, `undecodable` where it is null."""
    over = (F.length("text") > max_chars) | (F.octet_length("text") > max_bytes)
    status = F.when(F.col("text").isNull(), "undecodable").when(over, "rejected").otherwise("admitted")
    return docs.withColumn("status", status).withColumn("reason", F.when(F.col("text").isNull(), "no-decoded-text").when(over, "full-evidence analysis limit exceeded"))


def finding(id_: Column | str, category: Column | str, severity: Column | str, materiality: Column | str, start: Column | None, end: Column | None, detail: Column, **evidence: Column) -> Column:
    one = [F.lit(x) if isinstance(x, str) else x for x in (id_, category, severity, materiality)]
    spans = [F.lit(None).cast("int") if x is None else x.cast("int") for x in (start, end)]
    why = F.try_element_at(F.map_from_arrays(F.lit(list(EXPLAINED)), F.lit(list(EXPLAINED.values()))), one[1])
    shown = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])) if evidence else F.lit("{}")
    return F.struct(*[c.alias(n) for c, n in zip([*one, *spans, detail.cast("string"), why, shown], FIELDS, strict=True)])


def none() -> Column:
    return F.array().cast(FINDINGS)


def where(condition: Column, found: Column) -> Column:
    """An array of the finding if the condition holds."""
    return F.when(condition, F.array(found)).otherwise(none())


def spots(text: Column, odd: Column, test) -> Column:
    """i and c of the characters beyond printable ASCII for which a test of a column holds. odd: text.odd of the text."""
    wanted = F.array_join(F.filter(F.split(odd, ""), test), "")  # the few characters to look for
    found = F.transform(F.split(text, ""), lambda c, i: F.when(((c > "~") | (c < " ")) & (c != "") & test(c), F.struct(i.alias("i"), c.alias("c"))))
    return F.when(wanted != "", F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<i:int,c:string>>"))


def in_class(cls: str):
    return lambda c: c.rlike(cls)


def alike(table: dict[str, str]):
    """A test for characters beyond ASCII that have a look-alike: one look-up, as the class would be thousands of ranges."""
    sources = "".join(c for c, x in table.items() if ord(c) > 127 and x != c)
    return lambda c: (F.translate(c, sources, "") == "") & (c != "") if sources else F.lit(False)


def in_emoji(text: Column, idx: Column) -> Column:
    """Whether the nearest characters on both sides, past variation selectors, are emoji."""
    skip = F.lit("".join(chr(cp) for a, b in U.VARIATION for cp in range(a, b + 1)))
    before, after = F.rtrim(F.substr(text, F.lit(1), idx), skip), F.ltrim(F.substr(text, idx + 2, F.length(text)), skip)
    return F.right(before, F.lit(1)).rlike(U.pattern("emoji")) & F.left(after, F.lit(1)).rlike(U.pattern("emoji"))


def invisible_of(text: Column, found: Column) -> Column:
    """found: spots of at least the class `invisible`."""
    cps, names = U.names("invisible")
    known = F.map_from_arrays(F.lit(cps), F.lit(names))

    def one(x: Column) -> Column:
        cp, ch = F.ascii(x["c"]), x["c"]
        emoji = F.when(cp == 0x200D, in_emoji(text, x["i"])).otherwise(False)
        soft = ch.rlike(U.pattern("variation")) | emoji
        tag, strong = ch.rlike(U.pattern("tags")), cp.isin(U.STRONG_BIDI)
        severity = F.when(soft, "info").when(tag, "medium").when(strong, "high").otherwise("medium")
        materiality = F.when(soft | tag, "context-dependent").when(strong, "material").otherwise("potentially-material")
        return finding(F.concat(F.lit("unicode-invisible:"), x["i"].cast("string")), "invisible-unicode", severity, materiality, x["i"], x["i"] + 1, T.codepoint_name(cp), codepoint=T.codepoint_name(cp), name=F.try_element_at(known, cp), emoji_context=emoji)

    return F.transform(F.filter(found, lambda x: x["c"].rlike(U.pattern("invisible"))), one)


def bidi_of(found: Column) -> Column:
    """found: spots of at least the class `bidi`. In addition to what invisible_of says."""

    def one(x: Column) -> Column:
        cp = F.ascii(x["c"])
        strong = cp.isin(U.STRONG_BIDI)
        strength = F.when(strong, "strong").otherwise("mark")
        return finding(F.concat(F.lit("bidi-control:"), x["i"].cast("string")), "bidi-reordering", F.when(strong, "high").otherwise("medium"), F.when(strong, "material").otherwise("potentially-material"), x["i"], x["i"] + 1, strength, codepoint=T.codepoint_name(cp), strength=strength)

    return F.transform(F.filter(found, lambda x: x["c"].rlike(U.pattern("bidi"))), one)


def carrier_counts(text: Column) -> Column:
    """carriers, distinct_carriers, density, suspicious."""
    found = F.regexp_extract_all(text, F.lit(f"({U.guarded(U.pattern('carriers'))})"), F.lit(1))
    n, kinds = F.size(found), F.size(F.array_distinct(found))
    density = n / F.length(text)
    few = kinds <= F.greatest(F.lit(2), F.floor(n / 2))
    return F.struct(n.alias("carriers"), kinds.alias("distinct_carriers"), F.round(density, 6).alias("density"), ((n >= 4) & ((density >= 0.05) | few)).alias("suspicious"))


def carriers(docs: DataFrame) -> DataFrame:
    """doc_id, carriers, distinct_carriers, density, suspicious, of texts that have any."""
    return docs.filter(F.col("text").rlike(U.guarded(U.pattern("carriers")))).select("doc_id", carrier_counts(F.col("text")).alias("x")).select("doc_id", "x.*")


def carriers_of(text: Column, odd: Column) -> Column:
    x = F.when(odd.rlike(U.pattern("carriers")), carrier_counts(text))
    return where(F.coalesce(x["suspicious"], F.lit(False)), finding("hidden-carrier-pattern", "watermark-like-hidden-text", "low", "context-dependent", None, None, x["carriers"], carriers=x["carriers"], distinct_carriers=x["distinct_carriers"], density=x["density"]))


def runs_of(text: Column, odd: Column | None = None) -> Column:
    """start, end, decoded, terminated, flag: the runs of tag characters. Gaps between runs give the offsets."""
    runs, gaps = F.regexp_extract_all(text, F.lit(f"({T.TAG_RUN})"), F.lit(1)), F.split(text, T.TAG_RUN)

    def one(run: Column, n: Column) -> Column:
        start = F.aggregate(F.slice(runs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(gaps, F.lit(1), n + 1), F.lit(0), lambda a, x: a + F.length(x))
        decoded, terminated = T.decoded_tags(run), run.endswith(chr(0xE007F))
        flag = F.coalesce(terminated & decoded.isin(U.FLAGS) & F.get(gaps, n).endswith(chr(0x1F3F4)), F.lit(False))
        return F.struct(start.alias("start"), (start + F.length(run)).alias("end"), decoded.alias("decoded"), terminated.alias("terminated"), flag.alias("flag"))

    empty = F.array().cast("array<struct<start:int,end:int,decoded:string,terminated:boolean,flag:boolean>>")
    some = text.rlike(U.guarded(U.pattern("tags"))) if odd is None else odd.rlike(U.pattern("tags"))
    return F.when(some, F.transform(runs, one)).otherwise(empty)


def tag_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n, start, end, decoded, terminated, flag."""
    rows = docs.filter(F.col("text").rlike(U.guarded(U.pattern("tags")))).select("doc_id", F.posexplode(runs_of(F.col("text"))).alias("n", "x"))
    return rows.select("doc_id", "n", "x.*")


def tags_of(runs: Column) -> Column:
    def one(x: Column, n: Column) -> Column:
        flag = x["flag"]
        kind = F.when(flag, "unicode-tag-sequence").otherwise("ascii-smuggling")
        return finding(F.concat(F.lit("unicode-tags:"), n.cast("string")), kind, F.when(flag, "info").otherwise("high"), F.when(flag, "context-dependent").otherwise("material"), x["start"], x["end"], x["decoded"], decoded=x["decoded"], terminated=x["terminated"])

    return F.transform(runs, one)


def normalization_of(text: Column, nfc: Column, nfkc: Column) -> Column:
    changed = (nfc != text) | (nfkc != text)
    seen = (nfkc != text) & (T.human_projection(nfkc) != T.human_projection(text))
    hashes = {"text_sha256": T.sha256(text), "nfc_sha256": T.sha256(nfc), "nfkc_sha256": T.sha256(nfkc)}
    return where(changed, finding("normalization-delta", "normalization", "medium", F.when(seen, "material").otherwise("context-dependent"), None, None, hashes["nfkc_sha256"], nfc_changed=nfc != text, nfkc_changed=nfkc != text, **hashes))


def normalization(docs: DataFrame) -> DataFrame:
    """doc_id, nfc, nfkc, nfc_changed, nfkc_changed, materiality; ASCII texts are their own normal forms and are left out."""
    rows = T.with_forms(docs.filter(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "text"), {}, F.col("text")).select("doc_id", "text", "forms.nfc", "forms.nfkc")
    rows = rows.withColumns({"nfc_changed": F.col("nfc") != F.col("text"), "nfkc_changed": F.col("nfkc") != F.col("text")})
    seen = F.col("nfkc_changed") & (T.human_projection(F.col("nfkc")) != T.human_projection(F.col("text")))
    return rows.withColumn("materiality", F.when(seen, "material").otherwise("context-dependent")).drop("text")


def scripts_of(text: Column, odd: Column) -> Column:
    """The families of scripts in a text, in order. odd: text.odd of the text."""
    latin = text.rlike("[A-Za-z]")
    has = {s: odd.rlike(c) | latin if s == "Latin" else odd.rlike(c) for s, c in sorted(U.script_classes().items())}
    return F.filter(F.array(*[F.when(x, F.lit(s)) for s, x in has.items()]), lambda x: x.isNotNull())


def mixed(scripts: Column) -> Column:
    """Whether scripts that spoofing mixes meet."""
    return F.size(F.array_intersect(scripts, F.array(*map(F.lit, ("Latin", "Cyrillic", "Greek"))))) > 1


def confusables(docs: DataFrame, table: dict[str, str]) -> DataFrame:
    """doc_id, positions, scripts, mixed, of texts with look-alikes."""
    text, odd = F.col("text"), F.col("odd")
    rows = docs.select("doc_id", "text", once(T.odd(text)).alias("odd")).select("doc_id", "text", "odd", once(spots(text, odd, alike(table))).alias("spots")).filter(F.size("spots") > 0)
    rows = rows.select("doc_id", F.transform("spots", lambda x: x["i"]).alias("positions"), once(scripts_of(text, odd)).alias("scripts"))
    return rows.withColumn("mixed", mixed(F.col("scripts")))


def confusables_of(text: Column, odd: Column, found: Column, table: dict[str, str]) -> Column:
    """found: spots of at least the characters with look-alikes."""
    test = alike(table)
    own = F.filter(found, lambda x: test(x["c"]))
    scripts = F.when(F.size(own) > 0, scripts_of(text, odd))
    mix = mixed(scripts)
    return where(F.size(own) > 0, finding("confusable-skeleton", "confusable-homoglyph", F.when(mix, "high").otherwise("low"), F.when(mix, "potentially-material").otherwise("context-dependent"), None, None, F.array_join(scripts, ","), positions=F.slice(F.transform(own, lambda x: x["i"]), 1, MAX_EVIDENCE), count=F.size(own), scripts=scripts))


def html_of(page: Column, browser: Column | None = None) -> Column:
    """page: the struct of operators.html; browser: what an observer saw, or null. A null page has no finding."""
    some = lambda x: F.coalesce(F.size(x), F.lit(0))
    hidden = where((some(page["hidden"]) > 0) | (some(page["attrs"]) > 0), finding("html-hidden-content", "hidden-html-css", "high", "material", None, None, F.size(page["hidden"]), fragments=F.slice(page["hidden"], 1, MAX_EVIDENCE), attributes=F.slice(page["attrs"], 1, MAX_EVIDENCE)))
    comments = where(some(page["comments"]) > 0, finding("html-comments", "non-rendered-html", "low", "context-dependent", None, None, F.size(page["comments"]), comments=F.slice(page["comments"], 1, MAX_EVIDENCE)))
    out = F.concat(hidden, comments)
    if browser is None:
        return out
    differs = F.coalesce(browser != page["visible"], F.lit(False))
    return F.concat(out, where(differs, finding("render-observer-divergence", "render-observer-divergence", "medium", "potentially-material", None, None, T.sha256(browser), browser_sha256=T.sha256(browser), markup_sha256=T.sha256(page["visible"]))))


def once(made: Column) -> Column:
    """A column that the optimiser computes once for a row. It counts as not deterministic, so that no copy of its expression
    goes into a filter below or into each of its uses, where large expressions over each other would multiply.
    """
    return F.when(F.spark_partition_id() >= 0, made)


def exploded(docs: DataFrame, found: Column) -> DataFrame:
    """doc_id and the fields of each finding."""
    return docs.select("doc_id", F.explode_outer(found).alias("f")).filter("f IS NOT NULL").select("doc_id", "f.*")


def with_spots(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, text and spots of the texts that have characters of a class of unicode_tables."""
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike(U.guarded(U.pattern(name))))
    return rows.select("doc_id", "text", once(spots(F.col("text"), T.odd(F.col("text")), in_class(U.pattern(name)))).alias("spots"))


def invisible(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return exploded(with_spots(docs, "invisible"), invisible_of(text, F.col("spots")))


def bidi(docs: DataFrame) -> DataFrame:
    return exploded(with_spots(docs, "bidi"), bidi_of(F.col("spots")))


def html_findings(pages: DataFrame) -> DataFrame:
    """pages: doc_id and the struct `html` of operators.html, and the optional column browser_text."""
    return exploded(pages, html_of(F.col("html"), F.col("browser_text") if "browser_text" in pages.columns else None))


def invalid_utf8(files: DataFrame) -> DataFrame:
    """files: doc_id, content. Bytes that are no UTF-8; the span is in bytes, from the longest valid beginning."""

    @F.pandas_udf("start int, end int, offending string")
    def span(content):
        import pandas as pd

        def one(data: bytes) -> tuple:
            try:
                bytes(data).decode("utf-8")
            except UnicodeDecodeError as e:
                return e.start, e.end, bytes(data)[e.start : e.end].hex()
            return None, None, None

        return pd.DataFrame([one(x) for x in content], columns=["start", "end", "offending"])

    rows = files.filter(~F.is_valid_utf8("content")).select("doc_id", span("content").alias("s"))
    found = finding("invalid-utf8", "invalid-utf8", "high", "material", F.col("s.start"), F.col("s.end"), F.col("s.offending"), offending=F.col("s.offending"))
    return rows.select("doc_id", found.alias("f")).select("doc_id", "f.*")


def detected(docs: DataFrame, table: dict[str, str], text: Column | None = None, **kept: Column) -> DataFrame:
    """docs with the struct `forms` and the array `findings`, by id, of all detectors; and `runs`, the runs of tag characters.

    text may be null, which has no findings. html (struct) and browser_text are used if they are columns of docs.
    """
    text = F.col("text") if text is None else text
    twin, unseen = alike(table), in_class(U.pattern("invisible"))
    rows = T.with_forms(docs, table, text).withColumn("odd", once(T.odd(text)))
    odd = F.col("odd")
    rows = rows.withColumns({"spots": once(spots(text, odd, lambda c: unseen(c) | twin(c))), "runs": once(runs_of(text, odd))})
    parts = [invisible_of(text, F.col("spots")), bidi_of(F.col("spots")), carriers_of(text, odd), tags_of(F.col("runs")), normalization_of(text, F.col("forms.nfc"), F.col("forms.nfkc")), confusables_of(text, odd, F.col("spots"), table)]
    if "html" in docs.columns:
        parts.append(html_of(F.col("html"), F.col("browser_text") if "browser_text" in docs.columns else None))
    return rows.withColumn("findings", once(F.coalesce(F.array_sort(F.concat(*parts)), none()))).drop("spots", "odd")


def findings(docs: DataFrame, table: dict[str, str], overrides: dict[str, str] | None = None) -> DataFrame:
    """All findings of plain texts, one row each. overrides: a caller's look-alikes, which win over the table's."""
    return exploded(detected(docs.select("doc_id", "text"), U.combined(table, overrides)), F.col("findings")).select(*COLUMNS)


def by_category(found: DataFrame) -> DataFrame:
    """doc_id, category, n, materiality (the highest), ids in order."""
    out = found.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.max(level(F.col("materiality"), MATERIALITY)).alias("most"), F.array_sort(F.collect_set("id")).alias("ids"))
    return out.select("doc_id", "category", "n", named(F.col("most"), MATERIALITY).alias("materiality"), "ids")
