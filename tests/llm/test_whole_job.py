"""The corpus operators and stages where the whole job is more than the common case: tiny sources, null and repeated ids, many languages."""

import json
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscope.llm import common, exact_dedup, language_id, mixing, packing, registry, token_counts

SCHEMA = "doc_id long, text string, lang string"


def mixed(spark, sizes, words=50):
    """Tokens that each source has, and those that the default mix takes by its rates."""
    rows = [(f"{s}-{i}", f"{s} " * words, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, t, "en", s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out, want = mixing.mix(docs)
    have, got = defaultdict(float), defaultdict(float)
    for r in out.collect():
        have[r["source"]] += r["mix_tokens"]
        got[r["source"]] += r["mix_rate"] * r["mix_tokens"]
    return have, got, want


def test_a_tiny_source_does_not_fix_the_size_of_the_mix(spark):
    have, got, _ = mixed(spark, {f"s{i}": 60 for i in range(8)} | {"stray": 1})
    assert sum(got.values()) > 0.9 * sum(have.values())
    assert got["stray"] > 0.9 * have["stray"]


def test_only_sources_beyond_their_tempered_share_lose_tokens(spark):
    have, got, want = mixed(spark, {f"s{i}": 40 for i in range(6)} | {"hot": 400, "stray": 1})
    whole = sum(have.values())
    share = have["hot"] ** mixing.TEMPER / sum(h**mixing.TEMPER for h in have.values())
    assert want["hot"] == pytest.approx(whole * share, rel=0.1)  # posteriors move a few of the tokens between domains
    assert got["hot"] == pytest.approx(want["hot"], rel=0.05) and got["hot"] < 0.85 * have["hot"]
    assert all(got[s] > 0.9 * have[s] for s in have if s != "hot")


def spoken(syllables, seed, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(syllables.split(), k=2)) for _ in range(words))


def test_language_stage_decides_by_row(spark):
    kinds = {"aa": "th er on an ing", "bb": "ung sch ein lich", "cc": "eau ment que ais"}
    rows = [(i, spoken(kinds[lang], i), lang) for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]]
    odd = [(None, spoken(kinds["aa"], 900), "aa"), (None, spoken(kinds["bb"], 901), None), (5, "12 !!", "aa"), (7, None, "aa"), (None, "3.5", "cc")]
    out = language_id.stage(spark, spark.createDataFrame(rows + odd, SCHEMA), "")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rows + odd[:2]))


def test_exact_stage_keeps_one_row_of_each_text(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (None, "b", "x"), (None, None, "x"), (None, " ", "x"), (3, "c d", "x"), (4, "cd", "x"), (None, "c d", "x"), (6, "e", "x"), (6, "f", "y")]
    out = exact_dedup.stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    want = [(1, "a", "x"), (None, "b", "x"), (None, " ", "x"), (3, "c d", "x"), (6, "e", "x"), (6, "f", "y")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_every_language_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)} text", f"l{i % 40}") for i in range(120)] + [(500, "no language", None), (501, "12", "digits")]
    got = language_id.sample(spark.createDataFrame(rows, SCHEMA), texts=3)
    assert set(got) == {f"l{k}" for k in range(40)} and all(got.values())


def test_texts_without_letters_do_not_use_up_the_sample(spark):
    rows = [(i, "a word" if i % 200 == 0 else (None, "12 !!")[i % 2], "aa") for i in range(2400)]
    assert language_id.sample(spark.createDataFrame(rows, SCHEMA), texts=5)["aa"] == b" a word " * 5


@pytest.mark.parametrize("text", ["½", "²", "Ⅷ", "①", "12 ½!", "\u0301"])
def test_numerals_and_marks_are_no_letters(spark, text):
    df = spark.createDataFrame([(1, text, "aa")], SCHEMA)
    assert language_id.identify(df, {"aa": b"some words", "bb": b"other"}).first()["lang_pred"] == "und" and language_id.sample(df) == {}


def test_a_tie_of_two_languages_is_rejected(spark):
    df = spark.createDataFrame([(1, "some words that are here", None)], SCHEMA)
    row = language_id.identify(df, {"aa": b" x ", "bb": b" x "}).first()
    assert row["rejected"] and row["lang_pred"] == "aa" and row["score"] == pytest.approx(0.5)
    text = "some words that are here, and some more of them that nobody knows"
    row = language_id.identify(spark.createDataFrame([(1, text, None)], SCHEMA), {"aa": language_id.prepared(text), "bb": b" x "}).first()
    assert not row["rejected"] and row["score"] > 0.9


def test_whole_texts_are_learned(spark):
    text = "a " * 5000 + "ending"
    assert language_id.sample(spark.createDataFrame([(1, text, "aa")], SCHEMA))["aa"].endswith(b" ending ")


def expected(docs, out, noise=mixing.NOISE):
    """Expected tokens of each domain by the rates, with posteriors from dictionaries."""
    rows = [r.asDict() for r in mixing.evidence(docs).collect()]
    rate = {r["doc_id"]: r["mix_rate"] for r in out.collect()}
    known = [r for r in rows if r["mix_source"]]
    sizes = Counter(r["mix_source"] for r in known)
    names, prior = sorted(sizes), mixing.PRIOR
    seen = Counter((f, r[f"mix_{f}"], r["mix_source"]) for r in known for f in mixing.EVIDENCE)
    total = dict.fromkeys(names, 0.0)
    for r in rows:
        logs = []
        for d in names:
            x = math.log((sizes[d] + prior) / (len(known) + prior * len(names)))
            x += sum(math.log(seen[f, r[f"mix_{f}"], d] + prior) - math.log(sizes[d] + 32 * prior) for f in mixing.EVIDENCE if r[f"mix_{f}"])
            x += 0 if not r["mix_source"] else math.log(1 - noise) if r["mix_source"] == d else math.log(noise / (len(names) - 1))
            logs.append(x)
        p = np.exp(np.array(logs) - max(logs))
        for d, share in zip(names, p / p.sum(), strict=True):
            total[d] += share * rate[r["doc_id"]] * r["mix_tokens"]
    return total


def test_each_domain_meets_its_target(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        source = rng.choice(["big", "big", "big", "mid", "low", None])
        words = ["WORD" if source == "mid" else "word"] * (10 if source == "low" else rng.randint(20, 400))
        rows.append((i, " ".join(words), "de" if source == "low" else "en", source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out, want = mixing.mix(docs, {"big": 2.0, "mid": 1.0, "low": 0.2}, tokens=9000)
    got = expected(docs, out)
    assert all(got[d] == pytest.approx(want[d], rel=0.02) for d in want)


def test_evidence_outweighs_a_wrong_source(spark):
    rows = [(i, "word " * 300 if i % 2 else "WORD | " * 10, "en" if i % 2 else "de", "long" if i % 2 else "loud") for i in range(400)]
    wrong = [(1000, "WORD | " * 10, "de", "long")]
    docs = spark.createDataFrame(rows + wrong, "doc_id long, text string, lang string, source string")
    named = {r["doc_id"]: r["mix_domain"] for r in mixing.mix(docs)[0].collect()}
    assert named[1000] == "loud" and named[1] == "long"


def test_too_many_domains_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 3)
    docs = spark.createDataFrame([(i, "a b", "en", f"s{i}") for i in range(5)], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError):
        mixing.mix(docs)


def test_another_vocabulary_is_refused(tmp_path):
    import public_tokenizers

    file = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    file["normalizer"] = {"type": "NFKC"}
    (tmp_path / "other.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        token_counts.Counter(str(tmp_path / "other.json"))


@pytest.mark.parametrize("seed", range(40))
def test_planned_sequences_are_near_the_optimum(seed):
    from .test_operators import optimum

    rng = random.Random(seed)
    items = sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 10))), reverse=True)
    plan = packing.planned(Counter(items), 20)
    used = defaultdict(int)
    for w, n in Counter(items).items():
        for rank in range(n):
            row = max((r for r in plan.tolist() if r[0] == w and r[1] <= rank), key=lambda r: r[1])
            used[row[2] + (rank - row[1]) // row[3]] += w
    assert max(used.values()) <= 20 and optimum(items, 20) <= len(used) <= optimum(items, 20) + 1


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, digest string, component_id long, mix_rate string, salt int"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, repeated ids, ties and columns with the operators' own names."""
    rng = random.Random(12)
    words = ["the", "of", "and", "language", "people", "water", "house", "little", "under", "because"]
    prose = [" ".join(rng.choices(words, k=rng.randint(30, 80))) for _ in range(24)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", 1, "d", 7, "r", 2) for i, t in enumerate(prose)]
    long = " ".join(rng.choices(words, k=30_000))
    near = prose[3].rsplit(" ", 1)[0] + " water"
    plain = ["en", "s1", 1, "x", 1, "d", 7, "r", 2]
    rows += [(50, long, *plain), (None, long + " end", *plain), (None, prose[0] + " more", *plain), (51, near, *plain), (None, None, *[None] * 9), (52, "", *plain), (53, "12 !!", *plain)]
    rows += [rows[5], rows[5], (6, prose[7] + " again", *plain), (6, "people under water " * 9, *plain), (None, prose[8], *plain)]
    return spark.createDataFrame(rows, STAGE_SCHEMA).repartition(3)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    docs = odd_documents(spark)
    rows = Counter(map(tuple, docs.collect()))
    out = stage(spark, docs, "")
    kept = [tuple(r) for r in out.collect()]
    if name == "packing":
        assert sum(r["piece"] == 0 for r in out.collect()) == sum(rows.values())
        return
    assert out.columns == docs.columns and not Counter(kept) - rows  # whole rows, none made up
    texts = {r[1] for r in kept}
    if name == "language_id":
        assert {r[1] for r in rows} - texts == {None, "", "12 !!"} and len(kept) == sum(rows.values()) - 3
    if name == "exact_dedup":
        assert sorted(Counter("".join((t or "").split()) for t in (r[1] for r in kept)).values()) == [1] * len({"".join((r[1] or "").split()) for r in rows})
    if name == "near_dedup":
        from .test_operators import sets

        distinct = list({t: sets(t) for t in {r[1] for r in rows}}.items())
        for i, (t, a) in enumerate(distinct):
            for u, b in distinct[:i]:
                if a and 100 * len(a & b) >= 80 * len(a | b):
                    assert not (t in texts and u in texts)
            if not any(a and 100 * len(a & b) >= 80 * len(a | b) for u, b in distinct if u != t):
                assert t in texts
    if name == "mixing":
        assert kept


@pytest.mark.parametrize("name", registry.QUERIES)
def test_queries_over_odd_tables(spark, tmp_path, name):
    odd_documents(spark).drop("id", "n", "digest", "component_id", "mix_rate", "salt").filter("doc_id IS NULL OR doc_id <> 6").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(24)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, None, "b")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    n = common.table(spark, str(tmp_path), "documents").count()
    if "chat" in name:
        assert {r["conv_id"] for r in rows} == {-1, 1, 2}
    elif "packing" in name:
        assert sum(r["piece"] == 0 for r in rows) == n
    else:
        assert len(rows) == n


@pytest.mark.parametrize("salts, digest", [(1, exact_dedup.sha256), (3, exact_dedup.sha256), (3, lambda c: F.length(c).cast("string"))])
def test_whole_rows_that_stay(spark, salts, digest):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choices("ab ", k=rng.randint(0, 5))) if i % 9 else None, f"l{i}") for i in range(300)] + [(1000 + i, "hot  text", f"h{i}") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    kept = [tuple(r) for r in exact_dedup.exact_dedup(df, salts=salts, digest=digest, whole=True).collect()]
    best = {}
    for k, t, _ in rows:
        at = "".join((t or "").split())
        best[at] = max(best.get(at, (-1, 0)), (len(t or ""), -math.inf if k is None else -k))
    got = {"".join((t or "").split()): (len(t or ""), -math.inf if k is None else -k) for k, t, _ in kept}
    assert got == best and len(kept) == len(best) and not set(kept) - set(rows)


def test_exact_stage_combines_by_partition_by_salt_and_across_salts(spark):
    docs = spark.createDataFrame([(i, "hot text" if i % 2 else f"text {i}", "x") for i in range(60)], SCHEMA).repartition(8)
    out = exact_dedup.stage(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line and "digest" in line]
    keys = [[k.split("#")[0].strip() for k in line.split(")")[0].split(",")[:-1]] for line in dealt]
    assert keys == [["digest"], ["digest", "salt", "content"]]  # across salts, and before that by salt
    assert plan.count("Aggregate(key=[digest") == 4 and out.count() == 31
