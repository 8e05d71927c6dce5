import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilscope.functions import hooks
from veilscope.functions import unicode_tables as U
from veilscope.operators import analysis, assurance, detect, html
from veilscope.sinks import integrity, reports
from veilscope.sources import readers


@pytest.mark.parametrize(
    "page, visible, hidden",
    [
        ('<h1>Menu</h1><span style="visibility: hidden">soup</span>', "Menu", ["soup"]),
        ("<style>#x, .off { opacity:0 } a { color:red }</style><i id=x>one</i><b class='big off'>two</b><a>three</a>", "three", ["one", "two"]),
        ("<style>div.off { display:none }</style><div class=off>seen</div>", "seen", []),
        ('<p style="opacity:0.5">x</p>', "", ["x"]),
        ('<p style="background-color:transparent">x</p>', "x", []),
        ("<p hidden>a<p>b", "", ["a", "b"]),
        ("<title>t</title><div hidden><script>s</script></div>y", "ty", []),
        ("x &am", "", []),
        ("a<!-- open", "a", []),
        ('<br hidden>a<b aria-hidden="TRUE">c</b></i>d', "ad", ["c"]),
        ("<ul hidden><li>a<li>b</ul>c", "c", ["a", "b"]),
    ],
)
def test_visibility(page, visible, hidden):
    got = html.read(page)
    assert got["visible"] == visible and [x["text"] for x in got["hidden"]] == hidden


@pytest.mark.parametrize("page, visible", [("<title>this and&amp</title>b", "this and&b"), ("<p>a &lt b &copy 1</p>", "a < b © 1"), ("<p>&amp;amp &am</p>", "&amp &am")])
def test_references_without_a_semicolon(page, visible):
    assert html.read(page)["visible"] == visible


def test_hidden_reasons_and_inputs():
    got = html.read('<div hidden style="left:-9999px">a<u class=k>b</u></div><input TYPE="Hidden" value="token" name=n><input value=w><noscript>js off</noscript>')
    assert [(x["reason"], x["tag"]) for x in got["hidden"]] == [("hidden-attribute,css-hidden-inline", "div"), ("hidden-attribute,css-hidden-inline", "u")]
    assert [x["text"] for x in got["attrs"]] == ["token"] and got["non_rendered"] == [{"text": "js off", "reason": "non-rendered-noscript", "tag": "noscript"}]


def test_html_findings(spark):
    pages = html.inspect(spark.createDataFrame([(1, "<p>Source</p><!-- c -->", "Rendered"), (2, "<p>a</p>", "a")], "doc_id long, text string, browser_text string"))
    assert sorted((r["doc_id"], r["category"]) for r in detect.html_findings(pages).collect()) == [(1, "non-rendered-html"), (1, "render-observer-divergence")]


class Key:
    """Signs by a keyed hash, as a stand-in for a signature library."""

    def sign(self, data):
        return hashlib.sha256(b"key" + data).digest()

    def verify(self, mark, data):
        if mark != self.sign(data):
            raise RuntimeError("bad signature")


def intact(source=b"some bytes\xfe"):
    return integrity.receipted({"input": {"sha256": hashlib.sha256(source).hexdigest()}, "n": 1})


def test_receipts():
    report = intact()
    assert integrity.verify(report) and not any(map(integrity.verify, (report | {"n": 2}, None, {"receipt": {}}, [], "x")))
    with pytest.raises(ValueError):
        integrity.canonical({"x": float("nan")})


def test_seals():
    report = intact()
    plain, signed = integrity.seal(report), integrity.seal(report, Key(), "k1")
    assert integrity.verify_seal(report, plain) and integrity.verify_seal(report, signed, Key())
    for bad, key in ((plain | {"key_id": "k"}, None), (plain, Key()), (signed, None), (signed | {"key_id": "k2"}, Key()), (signed | {"signature": "AAAA"}, Key()), (plain | {"algorithm": "Ed25519"}, None), ({}, None), (None, None), (plain | {"schema": "other"}, None)):
        assert not integrity.verify_seal(report, bad, key)
    assert not integrity.verify_seal(integrity.receipted({"n": 3}), plain)
    for arguments in ((report, Key()), (report | {"n": 2},)):
        with pytest.raises(ValueError):
            integrity.seal(*arguments)


def test_bundles():
    source = b"some bytes\xfe"
    report = intact(source)
    data = integrity.bundle(report, source)
    assert integrity.verify_bundle(data) and data == integrity.bundle(report, source) and not integrity.verify_bundle(b"x") and not integrity.verify_bundle(None)
    for changed in ({"evidence.bin": b"changed"}, {"more": b""}, {"report.json": b"{}"}, {"manifest.json": b"[]"}):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
            for n in {**dict.fromkeys(old.namelist()), **changed}:
                new.writestr(n, changed.get(n) if n in changed else old.read(n))
        assert not integrity.verify_bundle(out.getvalue())
    with pytest.raises(ValueError):
        integrity.bundle(report, b"other")


def test_reports(spark):
    docs = spark.createDataFrame([(1, "one two\nthr\u200bee"), (2, "plain <b>"), (3, None)], "doc_id long, text string")
    rows = reports.reports(analysis.analyzed(docs, {}))
    place = reports.locations(rows).first()
    assert (place["start_line"], place["start_col"], place["end_col"], place["level"]) == (2, 4, 5, "warning")
    out = rows.withColumns({"t": reports.text_report(rows), "h": reports.html_report(rows)}).orderBy("doc_id").collect()
    assert "- None" in out[1]["t"] and "&lt;b&gt;" in out[1]["h"] and "Content-Security-Policy" in out[1]["h"] and integrity.verify(json.loads(out[0]["report"]))
    assert "ZERO WIDTH SPACE" in out[0]["t"] and "<td>medium</td>" in out[0]["h"] and "No verdict: no-decoded-text" in out[2]["t"]
    body = json.loads(out[0]["report"])
    assert body["schema"] == reports.SCHEMA and body["findings"][0]["explanation"] and body["views"]["texts"]["machine"]["text"] == "one two\nthr\u200bee" and "summary" not in json.loads(out[2]["report"])
    forged = rows.withColumn("report", F.replace("report", F.lit('"status":"admitted"'), F.lit('"status":"clean"')))
    assert [r[0] for r in forged.filter("doc_id < 3").select(reports.html_report(forged)).collect()] == [None, None]
    runs = json.loads(reports.sarif_file(reports.sarif(rows)).first()["sarif"])["runs"]
    assert runs[0]["results"][0]["ruleId"] == "invisible-unicode" and runs[0]["results"][0]["message"]["text"] and runs[1]["results"] == [] and len(runs) == 2
    assert reports.failed(rows) and not reports.failed(rows.filter("doc_id = 2"))


def office(name):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, "<r><a:t xmlns:a='u'>tick\u200bet</a:t><v>7</v><w>no</w></r>")
    return out.getvalue()


def test_sources(spark, tmp_path):
    for name, data in {"a.docx": office("word/document.xml"), "b.xlsx": office("xl/sharedStrings.xml"), "c.pptx": office("ppt/slides/slide1.xml"), "d.txt": b"abc\xffdef", "e.html": b"<p>x</p>", "f.bin": b"\0\1", "h.bin": b"STEP\n", "g.docx": b"no zip"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["filename"]: r for r in readers.acquired(readers.files(spark, str(tmp_path))).collect()}
    assert [rows[x]["text"] for x in ("a.docx", "b.xlsx", "c.pptx")] == ["tick\u200bet\n7"] * 3
    assert rows["d.txt"]["status"] == "undecodable" and rows["e.html"]["text"] == "<p>x</p>"
    assert rows["f.bin"]["reason"] == "binary" and rows["h.bin"]["reason"] == "unsupported format"
    assert rows["g.docx"]["status"] == "rejected"
    bad = detect.invalid_utf8(readers.files(spark, str(tmp_path)).filter("filename = 'd.txt'")).first()
    assert (bad["start"], bad["end"], bad["detail"]) == (3, 4, "ff")


@pytest.mark.parametrize("change, message", [(dict(MAX_MEMBERS=0), "too many"), (dict(MAX_EXPANDED=1), "too much"), (dict(MAX_MEMBER=1), "too large"), (dict(MAX_RATIO=0), "too tightly")])
def test_office_bounds(monkeypatch, change, message):
    for k, v in change.items():
        monkeypatch.setattr(readers, k, v)
    with pytest.raises(ValueError, match=message):
        readers.office_text(office("word/document.xml"))
    with pytest.raises(ValueError, match="declares"):
        readers.xml_texts(b"<!DOCTYPE x><t>a</t>")


def test_first_bytes_tell_a_type(spark):
    df = spark.createDataFrame([("a", b"%PDF-1.7"), ("b", b"PK\x03\x04rest"), ("c.txt", b"%PDF-"), ("d", b"text")], "name string, content binary")
    got = [r[0] for r in df.orderBy("name").select(readers.content_type(F.col("name"), content=F.col("content"))).collect()]
    assert got == ["application/pdf", readers.OFFICE, "text/plain", "application/octet-stream"]


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "small.txt").write_bytes(b"abc")
    (tmp_path / "large.txt").write_bytes(b"x" * 100)
    rows = {r["filename"]: r for r in readers.acquired(readers.files(spark, str(tmp_path), 50)).collect()}
    assert rows["small.txt"]["text"] == "abc" and rows["large.txt"]["content"] is None and rows["large.txt"]["status"] == "rejected"


def test_chunks(spark):
    rows = [(1, 1, b"\xe2\x80\x8bet"), (1, 0, b"tick"), (1, 0, b"tick"), (2, 0, b"x" * 10), (3, 0, b"a"), (3, 2, b"c"), (4, 0, b"a"), (4, 0, b"b"), (5, 1, b"b")]
    out = {r["doc_id"]: r for r in readers.reassembled(spark.createDataFrame(rows, "doc_id long, seq int, chunk binary"), 9).collect()}
    assert bytes(out[1]["content"]).decode() == "tick\u200bet" and out[1]["complete"] and out[1]["byte_length"] == 9
    assert {i: out[i]["reason"] for i in (2, 3, 4, 5)} == {2: "over the cap", 3: "a chunk is missing", 4: "chunks differ under one number", 5: "a chunk is missing"}
    assert all(out[i]["content"] is None and not out[i]["complete"] for i in (2, 3, 4, 5))


def test_assurance(spark):
    docs = spark.createDataFrame([(1, "\u2003hotel.org\n", "hoteⅼ.org", "admitted"), (2, "a", "b", "admitted"), (3, "same", "same", "admitted"), (4, None, None, "undecodable")], "doc_id long, visible string, expected_identity string, status string")
    edges = assurance.identity_edges(docs, U.default_confusables(spark) | {"ⅼ": "l"})
    assert {r["doc_id"]: r["materiality"] for r in edges.collect()} == {1: "potentially-material", 2: "context-dependent"}
    rolled = {r["doc_id"]: (r["disposition"], r["material"]) for r in assurance.rollup(docs, [edges]).collect()}
    assert rolled == {1: ("potentially-material", True), 2: ("context-dependent", False), 3: ("none", False), 4: ("unavailable", None)}


def test_claims(spark):
    views = spark.createDataFrame([(1, "machine text", "human")], "doc_id long, machine string, human string")
    spans = [[("machine", 0, 7, "machine", None)], [], [("machine", 0, 7, "forged", None)], [("machine", 0, 99, None, None)], [("human", 0, 5, None, "00")]]
    claims = spark.createDataFrame([(1, "identity", "material", s, str(i)) for i, s in enumerate(spans)], "doc_id long, boundary string, materiality string, evidence array<struct<view:string,start:int,end:int,text:string,sha256:string>>, explanation string")
    assert {r["explanation"]: r["valid"] for r in assurance.valid_claims(claims, views).collect()} == {"0": True, "1": False, "2": False, "3": False, "4": False}


def test_tokenizer_hook(spark):
    of = hooks.tokenizer(lambda t: t.split())
    row, gone = hooks.model_views(spark.createDataFrame([(1, "a b", "a"), (2, None, None)], "doc_id long, m string, h string"), of, F.col("m"), F.col("h")).orderBy("doc_id").collect()
    assert gone["equal"] is None and gone["token_count_delta"] is None
    assert not row["equal"] and row["token_count_delta"] == 1
    assert hooks.checked([1]) != hooks.checked(["1"])
    for bad in ([True], [1.5], "ab", [None]):
        with pytest.raises(TypeError):
            hooks.checked(bad)


def test_attached(spark):
    rows = analysis.analyzed(spark.createDataFrame([(1, "plain", "other"), (2, "plain", None), (3, None, None)], "doc_id long, text string, model_text string"), {})
    out = {r["doc_id"]: r for r in assurance.attached(rows, assurance.rollup(rows, [assurance.model_edges(rows)])).collect()}
    assert out[1]["summary"]["material_divergence"] and out[1]["summary"]["assurance_disposition"] == "potentially-material"
    assert not out[2]["summary"]["material_divergence"] and out[2]["assurance"]["coverage"]["model_input"] == "unavailable" and out[1]["assurance"]["coverage"]["model_input"] == "available"
    assert out[3]["summary"] is None and out[3]["assurance"]["disposition"] == "unavailable" and not out[3]["assurance"]["complete"]


def test_concealed_nodes(spark):
    nodes = [[(False, "\u2003 "), (True, "x")], [(True, "a"), (False, "b")]]
    df = spark.createDataFrame(list(enumerate(nodes)), "doc_id int, nodes array<struct<visible:boolean,text:string>>")
    assert [(r["doc_id"], r["n"], r["sha256"]) for r in assurance.concealed(df).collect()] == [(1, 1, [hashlib.sha256(b"b").hexdigest()])]


def test_behaviour(spark):
    rows = hooks.behaviour(spark.createDataFrame([(1, "a", "a"), (2, "a", "b")], "doc_id long, machine_response string, human_response string"))
    assert [r["materiality"] for r in rows.orderBy("doc_id").collect()] == ["none", "context-dependent"]
