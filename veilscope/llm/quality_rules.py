"""Quality rules as learned decision lists, in DataFrame operations only.

Statistics of each text are native expressions. Sequential covering learns from the labelled rows: a rule for poor
documents grows by the threshold with the best gain, is pruned on rows held apart, and what it covers is taken away
before the next. Each step is one grouped count over binned statistics. The rules become an ordered CASE expression.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Statistics that rules may test.
FEATURES = ["mean_chars", "symbols", "dup_lines", "repeats", "distinct", "capitals", "bangs", "digits", "short_words"]
CUTS, MOST_RULES, MOST_TESTS = 24, 8, 3
#: A rule must be right this often on the rows held apart, and cover so many rows.
PRECISION, LEAST = 0.95, 5


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what FEATURES need.

    A text is worked on inside its row. Positions of repeated windows are found by sorting hashes of windows, and only
    in texts in which some window repeats. Null counts as empty: all counts are 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def count(pattern: str) -> Column:
        return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")

    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", common.words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    windows = F.when(F.size("words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).cast("long").alias("n_short"),
        count(r"\p{Lu}").alias("n_capitals"),
        count("!").alias("n_bangs"),
        count("[0-9]").alias("n_digits"),
        windows.alias("windows"),
    )
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(F.size("windows") > F.size(F.array_distinct("windows")), ordered)).drop("windows")

    def twin(x: Column, k: Column) -> Column:
        return (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"])

    at = F.array_sort(F.transform(F.filter("ordered", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))
    rows = rows.withColumn("at", at).drop("ordered")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at").withColumnRenamed("id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def featured(counts: DataFrame) -> DataFrame:
    """The statistics of FEATURES beside the counts; 0 where a denominator is 0."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    of = {"mean_chars": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "distinct": ("n_distinct", "n_words")}
    of |= {"capitals": ("n_capitals", "word_chars"), "bangs": ("n_bangs", "n_words"), "digits": ("n_digits", "word_chars"), "short_words": ("n_short", "n_words")}
    return counts.withColumns({k: share(*v) for k, v in of.items()})


Rule = list[tuple[str, str, float]]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, side, cut in rule:
        out = out & (F.col(name) <= cut if side == "<=" else F.col(name) > cut)
    return out


def learned(rows: DataFrame) -> list[Rule]:
    """Rules for poor documents, in order. rows: FEATURES, boolean `poor` and boolean `grow`. No rules if a class is missing.

    The cuts are quantiles of each statistic among poor rows and among all; a step brings one count for each statistic
    and bin to the driver, whatever the number of rows.
    """
    spread = [(i + 0.5) / CUTS for i in range(CUTS)]
    found = rows.agg(*[F.percentile_approx(F.when(c, F.col(f)) if c is not None else F.col(f), spread, 10_000).alias(f"{f}_{k}") for f in FEATURES for k, c in (("all", None), ("poor", F.col("poor")))]).first()
    cuts = {f: sorted({*(found[f"{f}_all"] or []), *(found[f"{f}_poor"] or [])}) for f in FEATURES}

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])).cast("array<double>"), lambda t: t < F.col(f)))

    binned = rows.select("poor", "grow", *FEATURES, F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in FEATURES]).alias("bins"))
    binned = common.saved(rows.sparkSession, binned, "rules")
    rules: list[Rule] = []
    left = binned
    while len(rules) < MOST_RULES:
        rule: Rule = []
        growing = left.filter("grow")
        while len(rule) < MOST_TESTS:
            step = best_test(growing.filter(holds(rule)), cuts)
            if not step:
                break
            rule.append(step[0])
            if step[1]:
                break
        if not rule:
            break
        apart = left.filter("NOT grow")
        sums = apart.agg(*[F.sum((holds(rule[: k + 1]) & (F.col("poor") == y)).cast("long")).alias(f"{y}_{k}") for k in range(len(rule)) for y in (True, False)]).first()
        worth = []
        for k in range(len(rule)):
            p, n = sums[f"True_{k}"] or 0, sums[f"False_{k}"] or 0
            worth.append((((p - n) / (p + n)) if p + n else -1.0, -k, p, n))
        value, k, p, n = max(worth)
        rule = rule[: 1 - k]
        if p < LEAST or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left = left.filter(~holds(rule))
    return rules


def best_test(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[tuple[str, str, float], bool] | None:
    """The test with the best FOIL gain, and whether what it covers is all poor."""
    counts = rows.select("poor", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(F.sum(F.col("poor").cast("long")).alias("p"), F.count("*").alias("n")).collect()  # FEATURES by bins
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"] - r["p"])
    best = None
    for f in sorted(by):
        poor, good = (sum(x[k] for x in by[f].values()) for k in (0, 1))
        if not poor or not good:
            return None
        p = n = 0
        for b, cut in enumerate(cuts[f]):
            p, n = p + by[f].get(b, (0, 0))[0], n + by[f].get(b, (0, 0))[1]
            for side, a, c in (("<=", p, n), (">", poor - p, good - n)):
                if a >= LEAST and (a, c) != (poor, good):
                    gain = a * (log2(a / (a + c)) - log2(poor / (poor + good)))
                    if gain > 0 and (not best or gain > best[0]):
                        best = (gain, (f, side, cut), c == 0)
    return best[1:] if best else None


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first rule that holds rejects."""
    out = F
    for rule in rules:
        out = out.when(holds(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """One row for each row of df: id, counts, statistics, base_failed, kept; and the rules.

    kept is false where the base fails, else the list's verdict. Labels other than 0 and 1 and ids without a document are
    ignored; a document labelled twice counts twice. Without labels nothing but the base rejects. Null and empty texts
    have no words and fail the base. Repeated rows give repeated rows; other columns are not read.
    """
    spark = df.sparkSession
    rows = common.saved(spark, featured(counted(df, id_col, text_col)).withColumn("base_failed", base_failed()), "counts")
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("marked"), (F.col(label_col) == 0).alias("poor"))
    marked = rows.join(marks, F.col(id_col) == F.col("marked")).select("poor", (F.pmod(F.xxhash64(id_col), F.lit(3)) != 0).alias("grow"), *FEATURES)
    rules = learned(marked)
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
