"""Each operator against a brute-force version or a round trip, on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilscope.llm import chat_format, common, elias_fano, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, packing, quality_classifier, quality_rules, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, value long, digest string"


def table(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), columns.get("source", {}).get(i, f"s{i % 3}"), None if t is None else len(t), "x", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t", "a", "a", "é", "ab c", "ABC d", "x" * 30_000, "word " * 9_000, "<|endoftext|> it's 3,5 漢字😀"]
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(text):
    return WORDS.encode(text or "", add_special_tokens=False).ids


def test_mixing_meets_targets(spark):
    texts = [prose(i, 50 + i % 40) for i in range(300)] + [None, ""]
    docs = table(spark, texts, source={i: "big" if i % 2 else f"s{i % 3}" for i in range(290)} | {290: None, 300: None})
    targets = {"big": 1.0, "s0": 1.0, "s1": 1.0, "s2": 1.0, "absent": 5.0}
    out, want = mixing.mix(docs, targets, tokens=4000)
    got = defaultdict(float)
    rows = out.collect()
    assert len(rows) == 302 and set(out.columns) > set(docs.columns)
    for r in rows:
        assert 0 <= r["mix_rate"] <= 1 and r["mix_copies"] in (0, 1)
        got[r["mix_domain"]] += r["mix_rate"] * r["mix_tokens"]
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.02)
    assert all(r["mix_tokens"] == len((r["text"] or "").split()) for r in rows)
    assert mixing.mix(docs.limit(0))[0].count() == 0


@pytest.mark.parametrize("text", ODD)
def test_token_counts(text):
    count = token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(map(count.__getitem__, (text or "").encode().split())) == len(encoded(text))


def test_token_counts_random(spark):
    rng = random.Random(3)
    letters = list("abcXYZ019 -_./\n'sΣσİıÅé́あ漢😀ﬁǅ½²\x0b\x1c\x85 |<>") + ["<|endoftext|>", "'ll", "the", "ing"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = token_counts.token_counts(table(spark, texts), limit=5).collect()
    assert [(r["n_bytes"], r["n_tokens"]) for r in sorted(rows)] == [(len((t or "").encode()), len(encoded(t))) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c).cast("string")])
def test_exact_dedup(spark, digest):
    texts = [None, "", "a b", "ab", "a  b", "ba", "x", "x", " ", "b a\n"] + ["same text"] * 40
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(spark, texts).repartition(5), salts=3, digest=digest).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups["".join((t or "").split())].append(i)
    for members in groups.values():
        keep = min(members, key=lambda i: (-len(texts[i] or ""), i))
        for i in members:
            assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (keep, len(members), i == keep)
    assert len(rows) == len(texts) and exact_dedup.exact_dedup(table(spark, texts).limit(0)).count() == 0


def test_exact_dedup_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "a")], "doc_id long, text string")
    assert sorted(r["kept"] for r in exact_dedup.exact_dedup(df).collect()) == [False, False, False, True]


def test_quality_classifier(spark):
    texts = [prose(i, 80) if i % 4 else prose(i, 80).upper().replace(" ", "!! ") for i in range(160)] + [None, ""]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(100)] + [(9_999, 1)], "doc_id long, quality int")
    machine = quality_classifier.train(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, machine).collect()}
    assert len(rows) == 162 and all(0 <= s <= 1 for s in rows.values())
    assert sum((rows[i] >= 0.5) == bool(i % 4) for i in range(100, 160)) >= 57
    assert quality_classifier.train(docs, labels.limit(0)).score([b"x"], np.array([1.0]))[0] <= 1


def test_factorisation_identity():
    machine = quality_classifier.Machine()
    rng = np.random.default_rng(1)
    c, x = np.array([3, 9, 40]), rng.normal(size=3)
    machine.linear[c] = rng.normal(size=3)
    pairs = sum(machine.vectors[c[i]] @ machine.vectors[c[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert machine.raw(np.zeros(3, int), c, x, 1)[0][0] == pytest.approx(machine.linear[c] @ x + pairs)


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block, shingles", [(jaccard_join.BLOCK, jaccard_join.TRIE_SHINGLES), (4, 300)])
def test_jaccard_join(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # small ones salt nearly every meeting, and cut shards small
    monkeypatch.setattr(jaccard_join, "SEEN", min(jaccard_join.SEEN, block))
    monkeypatch.setattr(jaccard_join, "TRIE_SHINGLES", shingles)
    rng = random.Random(5)
    texts = [None, "", "a b", "A  b", "a b c", " "]
    for base in range(12):
        words = prose(base, rng.randint(20, 120), 5000).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    passage = prose(77, 60, 5000)
    texts += [f"{prose(200 + i, rng.randint(5, 20), 9000)} {passage}" for i in range(40)]
    of = [sets(t) for t in texts]
    least = list(range(len(texts)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in product(range(len(texts)), repeat=2):
        both = len(of[i] & of[j])
        if i < j and both and 100 * both >= 80 * len(of[i] | of[j]):
            a, b = sorted((find(i), find(j)))
            least[b] = a
    rows = {r["doc_id"]: r for r in jaccard_join.jaccard_components(table(spark, texts)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == {i: (len(of[i]), find(i)) for i in range(len(texts))}


def test_trie_walk():
    rng = np.random.default_rng(2)
    some = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(200)]
    some += [np.arange(5, dtype=np.uint64), np.arange(6, dtype=np.uint64), np.arange(3, dtype=np.uint64)]
    trie = jaccard_join.Trie(some, list(range(len(some))), [s.astype(">u8").tobytes() for s in some])
    probes = [*some[:20], *some[-3:], np.array([999], np.uint64)]
    want = {(k, i) for k, p in enumerate(probes) for i, s in enumerate(some) if 100 * len(np.intersect1d(s, p)) >= 80 * len(np.union1d(s, p))}
    assert set(trie.linked(probes)) == want


def test_shared_nodes_are_walked_once_for_all_probes():
    base = np.arange(0, 1000, 2, dtype=np.uint64)
    some = [np.append(base, np.uint64(2001 + k)) for k in range(50)]
    trie = jaccard_join.Trie(some, list(range(50)), [s.astype(">u8").tobytes() for s in some])
    assert len(trie.linked([*some, base])) == 50 * 51
    assert trie.walked == len(base) + 50  # the shared run, and one shingle of each set
    other = jaccard_join.Trie(some, list(range(50)), [s.astype(">u8").tobytes() for s in some])
    assert other.linked([base + np.uint64(1)]) == [] and other.walked == len(base)  # nothing below is visited


def test_forest():
    forest = jaccard_join.Forest()
    assert [forest.tie(*x) for x in ((1, 2), (3, 2), (1, 3), (5, 4), (4, 1), (5, 3))] == [True, True, False, True, True, False]


def test_parities():
    rng = np.random.default_rng(3)
    for n, m in product((0, 1, 63, 64, 65, 300, 1000), repeat=2):
        x, y = (np.unique(rng.integers(0, 1 << 62, k)).astype(np.uint64) for k in (n, m))
        y = np.union1d(y, x[: n // 2])
        only = len(np.setxor1d(x, y))
        assert jaccard_join.apart(jaccard_join.parities(x), jaccard_join.parities(y)) <= only
        assert jaccard_join.apart(jaccard_join.parities(x), jaccard_join.parities(x)) == 0
    far = np.unique(rng.integers(0, 1 << 62, 1000)).astype(np.uint64)  # half of 1,024 places differ, about
    assert jaccard_join.apart(jaccard_join.parities(x), jaccard_join.parities(far)) > 450


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 200)] + [(300, i) for i in range(301, 340)]
    rows = {r["id"]: r["component"] for r in jaccard_join.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(rows[i] == 0 for i in range(1, 31)) and rows[100] == rows[200] == 50 and rows[339] == 300


def test_samples_take_the_lowest_hashes(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "aa").otherwise("bb").alias("lang"), F.concat(F.lit("x"), F.col("id")).alias("text"))
    near = rows.filter(common.lowest(F.xxhash64("doc_id"), 200, 6000)).count()
    assert 140 < near < 260 and rows.filter(common.lowest(F.xxhash64("doc_id"), 6000, 6000)).count() == 6000
    got = language_id.sample(rows, texts=7)
    for lang in ("aa", "bb"):
        wanted = rows.filter(F.col("lang") == lang).orderBy(F.xxhash64("doc_id")).limit(7).collect()
        assert got[lang] == b"".join(language_id.prepared(r["text"]) for r in reversed(wanted))


def test_language_id(spark):
    syllables = {"aa": "th er on an ing", "bb": "ung sch ein lich", "cc": "eau ment que ais"}
    rng = random.Random(4)
    texts, langs = [], {}
    for i in range(120):
        lang = "aa" if i % 2 else ("bb", "cc")[i % 4 // 2]
        texts.append(" ".join("".join(rng.choices(syllables[lang].split(), k=2)) for _ in range(60)))
        langs[i] = lang
    docs = table(spark, [*texts, None, "", "12 !!"], lang=langs)
    model = language_id.sample(docs.filter("doc_id < 80"))
    rows = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert sum(rows[i]["lang_pred"] == langs[i] for i in range(80, 120)) >= 39
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["rejected"] and rows[i]["score"] == 0 for i in (120, 121, 122))
    assert language_id.identify(docs, {}).first()["lang_pred"] == "und"


def test_chat_format_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s>[\\\\/INST]<</s>", "<", "[", "", None, "é😀\n", "s>INST]", "\\"]
    rows = [(c, t, ("user", "assistant", None, "<s>")[(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(9) for t in range(c + 1)]
    df = spark.createDataFrame([(c, t, r, x, "clash") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv"]: r for r in chat_format.read_back(chat_format.chat_format(df)).collect()}
    for c in range(9):
        own = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest() and got[c]["n_turns"] == len(own)
        loss = "".join(x for r, x in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.chat_format(df.limit(0))).count() == 0


def counts(text):
    w = (text or "").split()
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {i for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rng = random.Random(8)
    texts = [None, "", "a " * 9, "a b c d e f g h " * 3, "one\none\n\n \ntwo\none", "é # | <x>"] + [prose(i, rng.randint(5, 60), rng.choice([2, 3, 400])) for i in range(60)]
    texts += [prose(i, 60) if i % 3 else prose(i, 60).replace(" ", " | ") for i in range(300)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(66 + i, 1 if i % 3 else 0) for i in range(300)] + [(5, 7), (None, 0)], "doc_id long, quality int")
    out, rules = quality_rules.quality_rules(docs, labels)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rules and len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert all(rows[66 + i]["kept"] == (bool(i % 3) and not rows[66 + i]["base_failed"]) for i in range(300))
    assert quality_rules.quality_rules(docs, labels.limit(0))[1] == []


def test_packing(spark):
    texts = [*ODD, *[prose(i, 5 + 37 * i % 900) for i in range(120)]]
    rows = packing.pack(table(spark, texts), capacity=512, part_rows=3).collect()
    places, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = [*encoded(texts[r["doc_id"]]), 1][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert all(sum(x[2] for x in whole[i]) == len(encoded(t)) + 1 and [x[0] for x in sorted(whole[i])] == list(range(len(whole[i]))) for i, t in enumerate(texts))
    assert len(places) <= -(-sum(r["length"] for r in rows) // 512) + 2
    assert packing.pack(table(spark, texts).limit(0)).count() == 0


def optimum(items, capacity):
    """Fewest bins, by trying everything."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in sorted({b: k for k, b in enumerate(bins)}.values()):
            if bins[k] + items[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 10))), reverse=True)
    fixed, left = packing.reduced(Counter(items), 20)
    rest = [k for k, n in left.items() for _ in range(n)]
    assert sorted([x for s, n in fixed for x in s * n] + rest) == sorted(items) and all(sum(s) <= 20 for s, _ in fixed)
    assert sum(n for _, n in fixed) + (optimum(sorted(rest, reverse=True), 20) if rest else 0) == optimum(items, 20)


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(3)
    for n, universe in ((0, 10), (1, 1 << 64), (5000, 1 << 40), (5000, 5001), (3000, 1 << 63)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        elias_fano.write(f"file://{tmp_path}", f"f{n}-{universe}", elias_fano.encode(values, universe))
        sequence = elias_fano.Sequence(elias_fano.mapped(f"file://{tmp_path}", f"f{n}-{universe}"))
        asked = np.concatenate([values, rng.integers(0, universe, 200, dtype=np.uint64)])
        place, found = sequence.successors(asked)
        assert (found == np.isin(asked, values)).all() and (place[found] == np.searchsorted(values, asked[found])).all()


def bands(n):
    return n - 1 if n <= 8 else 5 + n.bit_length() - 1


def interpolated(train, texts):
    """log10 probability of each text, with dictionaries only."""
    train, texts = ([[*(t or "").lower().split(), None] for t in x] for x in (train, texts))
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([None, *t], t))
    three = Counter(p for t in train for p in zip([None, *t], t, t[1:]))
    contexts = Counter()
    for (a, b, _), n in three.items():
        contexts[a, b] += n
    tokens, fresh = Counter(), Counter()
    for level, (grams, whole) in enumerate(((two, one), (three, contexts))):
        for g, n in grams.items():
            m = whole[g[0]] if level == 0 else whole[g[:2]]
            if m > 1:
                tokens[level, bands(m - 1)] += n
                fresh[level, bands(m - 1)] += n == 1
    weights = [lm_scoring.weighed([(tokens[level, b], fresh[level, b]) for b in range(lm_scoring.BANDS)]) for level in (0, 1)]
    below = sum(one.values()) + 0.5 * (len(one) + 1)

    def p2(a, b):
        x = weights[0][bands(one[a])] if one[a] else 1
        return (1 - x) * two[a, b] / max(1, one[a]) + x * (one[b] + 0.5) / below

    def p3(a, b, c):
        x = weights[1][bands(contexts[a, b])] if contexts[a, b] else 1
        return (1 - x) * three[a, b, c] / max(1, contexts[a, b]) + x * p2(b, c)

    return [np.log10(p2(None, t[0])) + sum(np.log10(p3(*g)) for g in zip([None, *t], t, t[1:])) for t in texts]


LEARNED = [None, "", "A b", *[prose(i, 30, 20) for i in range(60)], prose(3, 30, 20), "w1 w1 w1 w1 w2 w1 w1", "  "]


def test_lm_scoring(spark):
    texts = [*LEARNED, "unseen words here w1", "w1", "unseen", None]
    docs = table(spark, texts)
    held = len(LEARNED)
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    seen = Counter(x for t in tokens[:held] for x in t)
    total, types = sum(seen.values()), len(seen)
    want = interpolated(LEARNED, texts)
    results = []
    for shard_tokens, parts in ((37, 4), (lm_scoring.SHARD_TOKENS, 1), (500, 9)):
        model = lm_scoring.learn(docs.filter(F.col("doc_id") < held).repartition(parts), shard_tokens=shard_tokens)
        rows = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
        for i, t in enumerate(tokens):
            base = sum(np.log10((seen[x] + 0.5) / (total + 0.5 * (types + 1))) for x in t)
            assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(t), sum(seen[x] > 0 for x in t), total)
            assert rows[i]["base_score"] == pytest.approx(base) and rows[i]["score"] == pytest.approx(want[i], abs=3e-4 * len(t))
        results.append([rows[i]["score"] for i in range(len(texts))])
    assert results[0] == results[1] == results[2]  # how the levels are cut changes nothing


def test_lm_probabilities_sum_to_one(spark):
    docs = table(spark, LEARNED)
    trie = lm_scoring.Trie(*lm_scoring.learn(docs, shard_tokens=100))
    words = sorted({w for t in LEARNED for w in (t or "").lower().split()})
    for before in ("w1", "w1 w2", "", "nothing w3"):
        texts = [f"{before} {w}".encode() for w in [*words, "nowhere"]]
        r = lm_scoring.Read(trie, texts)
        last = np.cumsum(r.counts) - 2
        ends = lm_scoring.probabilities(trie, lm_scoring.Read(trie, [before.encode()]))[1][-1]
        assert (10 ** lm_scoring.probabilities(trie, r)[1][last]).sum() + 10**ends == pytest.approx(1, abs=2e-3)


def test_lm_scoring_of_odd_tables(spark):
    docs = table(spark, LEARNED)
    empty = lm_scoring.score(docs, lm_scoring.learn(docs.limit(0)))
    assert empty.agg(F.max("n_known")).first()[0] == 0
    odd = spark.createDataFrame([(None, "w1 w2"), (1, "w1 w2"), (1, "w1 w2"), (2, None)], "doc_id long, text string")
    model = lm_scoring.learn(docs)
    rows = lm_scoring.score(odd, model).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows if r["n_tokens"] == 3}) == 1
    assert lm_scoring.score(odd.limit(0), model).count() == 0
