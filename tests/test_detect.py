import json
import random

import pytest
from pyspark.sql import functions as F

from veilscope.functions import text as T
from veilscope.functions import unicode_tables as U
from veilscope.operators import analysis, compare, detect

TAG = lambda s: "".join(chr(0xE0000 + ord(c)) for c in s)
END = chr(0xE007F)


def found(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in detect.findings(docs, dict(zip(*U.COMPACT))).collect():
        out[r["doc_id"]].append(r)
    return docs, out


def test_detectors(spark):
    texts = ["Nothing here", "two\nlines\tand\r\n", "tick\u200bet", "Ledger" + TAG(" GO"), "a.doc\u202excod.b", "xy\u200fz", "gооgle", "Ｚebra", "\U0001f468\u200d\U0001f469\u200d\U0001f467"]
    texts += ["\U0001f3f4" + TAG("gbeng") + END, "\U0001f3f4" + TAG("other") + END, "\U0001f3f4" + TAG("gbeng"), "q\u200br\u200bs\u200bt\u200bu", "z\u200d", ""]
    docs, out = found(spark, *texts)
    kinds = {i: sorted({r["category"] for r in rows}) for i, rows in out.items()}
    assert kinds[0] == kinds[1] == kinds[14] == []
    assert [(r["start"], r["end"], r["detail"], r["materiality"]) for r in out[2]] == [(4, 5, "U+200B", "potentially-material")]
    assert json.loads(out[2][0]["evidence"])["name"] == "ZERO WIDTH SPACE" and out[2][0]["explanation"]
    smuggled = [r for r in out[3] if r["category"] == "ascii-smuggling"]
    assert [(r["detail"], r["start"], r["end"], r["materiality"]) for r in smuggled] == [(" GO", 6, 9, "material")]
    assert kinds[4] == ["bidi-reordering", "invisible-unicode"] and {r["materiality"] for r in out[4]} == {"material"}
    assert {r["detail"] for r in out[5] if r["category"] == "bidi-reordering"} == {"mark"}
    assert [(r["severity"], r["materiality"], r["detail"]) for r in out[6]] == [("high", "potentially-material", "Cyrillic,Latin")]
    assert "normalization" in kinds[7]
    assert {r["materiality"] for r in out[8] if r["category"] == "invisible-unicode"} == {"context-dependent"}
    assert "unicode-tag-sequence" in kinds[9] and "ascii-smuggling" not in kinds[9]
    assert "ascii-smuggling" in kinds[10] and "ascii-smuggling" in kinds[11]
    assert "watermark-like-hidden-text" in kinds[12]
    assert [r["materiality"] for r in out[13]] == ["potentially-material"]
    assert all([r["id"] for r in rows] == sorted(r["id"] for r in rows) for rows in out.values())
    rows = {r["doc_id"]: r["summary"] for r in analysis.analyzed(docs, {}).collect()}
    assert rows[0]["finding_count"] == 0 and rows[0]["severity"] == "info" and not rows[0]["material_divergence"] and rows[4]["severity"] == "high"


def test_script_families(spark):
    texts = ["abc", "é", "Зима", "λόγος", "かな", "カナ", "한글", "漢字", "שלום", "سلام", "नमस्ते", "ไทย", "1 ½ !", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(detect.scripts_of(F.col("text"), T.odd(F.col("text")))).collect()]
    assert got == [sorted({s for c in t if (s := U.script(c))}) for t in texts]
    assert [g[0] if g else None for g in got][:12] == ["Latin", "Latin", "Cyrillic", "Greek", "Japanese", "Japanese", "Korean", "Han", "Hebrew", "Arabic", "Devanagari", "Other"]


def test_tag_runs_split(spark):
    docs = spark.createDataFrame([(1, "a" + TAG("AB") + END + TAG("C") + "b" + END)], "doc_id long, text string")
    rows = [(r["n"], r["start"], r["end"], r["decoded"], r["terminated"]) for r in detect.tag_runs(docs).orderBy("n").collect()]
    assert rows == [(0, 1, 4, "AB", True), (1, 4, 5, "C", False), (2, 6, 7, "", True)]


def test_budgets(spark):
    docs = spark.createDataFrame([(0, "x" * 64_000), (1, "x" * 64_001), (2, None)], "doc_id long, text string")
    assert [r["status"] for r in detect.admitted(docs).orderBy("doc_id").collect()] == ["admitted", "rejected", "undecodable"]


@pytest.mark.parametrize("a, b, prefix, suffix", [("tick\u200bet", "ticket", 4, 2), ("same", "same", 4, 0), ("aa", "aaa", 2, 0), ("", "x", 0, 0), ("x" * 64_000, "x" * 63_999 + "y", 63_999, 0), ("abc", "xyz", 0, 0)])
def test_prefix_and_suffix(spark, a, b, prefix, suffix):
    df = spark.createDataFrame([(a, b)], "a string, b string").withColumn("p", T.common_prefix(F.col("a"), F.col("b")))
    row = df.withColumn("s", T.common_suffix(F.col("a"), F.col("b"), F.col("p"))).first()
    assert (row["p"], row["s"]) == (prefix, suffix)


def test_analysis_gates_before_it_judges(spark):
    docs = spark.createDataFrame([(0, "x" * 64_000), (1, "x" * 64_001), (2, None), (3, "\u200b" * 10_001), (4, "é" * 64_000 * 2), (5, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in analysis.analyzed(docs, {}).collect()}
    assert {i: (r["status"], r["reason"]) for i, r in rows.items()} == {0: ("admitted", None), 1: ("rejected", "full-evidence analysis limit exceeded"), 2: ("undecodable", "no-decoded-text"), 3: ("rejected", "finding budget exceeded"), 4: ("rejected", "full-evidence analysis limit exceeded"), 5: ("admitted", None)}
    assert all(rows[i][c] is None for i in (1, 2, 3, 4) for c in analysis.RESULT[2:])
    assert rows[5]["summary"]["finding_count"] == 0 and rows[1]["text"] == "x" * 64_001


def test_edges_need_findings_in_place(spark):
    docs = spark.createDataFrame([(0, "tick\u200bet"), (1, "plain words")], "doc_id long, text string")
    rows = {r["doc_id"]: {e["boundary"]: e for e in r["edges"]} for r in analysis.analyzed(docs, {}).collect()}
    assert rows[0]["visibility"]["materiality"] == "potentially-material" and rows[0]["visibility"]["first_difference"] == 4
    assert all(e["materiality"] == "none" and not e["finding_ids"] for e in rows[1].values())
    viewed = compare.with_views(docs.filter("doc_id = 0"), dict(zip(*U.COMPACT)))
    assert compare.comparisons(viewed).count() == 15
    views = {n: F.col(f"view_{n}") for n in compare.names(viewed)}
    for start, end, materiality, ids in ((100, 101, "context-dependent", []), (4, 5, "material", ["f"]), (0, 4, "context-dependent", []), (0, 5, "material", ["f"]), (None, None, "material", ["f"])):
        far = F.array(detect.finding("f", "invisible-unicode", "high", "material", F.lit(start).cast("int"), F.lit(end).cast("int"), F.lit("")))
        edge = next(e for e in viewed.select(compare.edges_of(views, far).alias("e")).first()["e"] if e["boundary"] == "visibility")
        assert (edge["materiality"], edge["finding_ids"]) == (materiality, ids)


def test_overrides_win(spark):
    docs = spark.createDataFrame([(0, "kаy"), (1, "kéy")], "doc_id long, text string")
    rows = detect.findings(docs, {"а": "a"}, {"é": "e", "а": "а"}).collect()
    assert [(r["doc_id"], r["category"]) for r in rows] == [(1, "confusable-homoglyph")]
    with pytest.raises(ValueError):
        U.combined({}, {"ab": "c"})


def test_by_category(spark):
    docs = spark.createDataFrame([(0, "a\u200bb\u200ec")], "doc_id long, text string")
    rows = {r["category"]: (r["n"], r["materiality"], r["ids"]) for r in detect.by_category(detect.findings(docs, {})).collect()}
    assert rows == {"invisible-unicode": (2, "potentially-material", ["unicode-invisible:1", "unicode-invisible:3"]), "bidi-reordering": (1, "potentially-material", ["bidi-control:3"])}


def test_random_texts_agree_with_scalar_rules(spark):
    rng = random.Random(0xDDC5)
    alphabet = "abcXYZ019 -_./\n​‍‮⁦⁩é́аο\U000e0020\U000e007f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 64))) for _ in range(300)]
    docs, out = found(spark, *texts)
    for i, t in enumerate(texts):
        want = {k for k, c in enumerate(t) if U.invisible(ord(c))}
        assert {r["start"] for r in out[i] if r["category"] == "invisible-unicode"} == want
        assert ("confusable-homoglyph" in {r["category"] for r in out[i]}) == any(c in t for c in "аο")


def test_confusables_file():
    table = U.parse_confusables("\ufeff# head\n0435 ; 0065 ; MA\n\n03B1 ;\t0061 ; MA # x\n006D ; 0072 006E\n")
    assert "sеα m".translate(str.maketrans(table)) == "sea rn"
    for bad in ("0061 0062 ; 0063", "0061", "0061 ;", "xyz ; 0061"):
        with pytest.raises(ValueError):
            U.parse_confusables(bad)
    with pytest.raises(ValueError):
        U.pinned_confusables(b"0435 ; 0065", "00")


def test_default_confusables(spark):
    table = U.default_confusables(spark)
    assert table["о"] == "o" and "​" not in table
