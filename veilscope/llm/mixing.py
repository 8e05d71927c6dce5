"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A table of labelled evidence gives each document posteriors over the domains: naive Bayes over a few cheap values. The
declared source is the label, and no evidence for itself: it enters as a statement that is wrong with a small
probability, so that strong evidence outweighs it. Documents with the same evidence form a cell. Projected-gradient least
squares finds a rate for each cell, between 0 and a cap, whose expected tokens of each domain meet the targets. A step
is one grouped sum over the cells, and a rate is a fold over the steps so far, so that no table is rewritten.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EVIDENCE = ["lang", "length", "capitals", "marks", "lines"]
#: Chance that a declared source is wrong; any other domain is then as likely.
NOISE = 0.005
#: Domains are a fold over literals in the plan; more than so many raise an error that asks for a coarser column.
MOST_DOMAINS = 2_000
#: Exponent of the default targets: shares of the domains' tokens to this power, so that large sources lose weight.
TEMPER = 0.7
STEPS, CLOSE, PRIOR, SLACK = 40, 1e-4, 0.5, 0.95
#: A cell table of at most so many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_CELLS = 50_000


def evidence(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_tokens (its words) and the columns of EVIDENCE as strings, under names that start with `mix_`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))

    def band(x: Column, *cuts: float) -> Column:
        return sum(((x > c).cast("int") for c in cuts), F.lit(0)).cast("string")

    def share(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / size

    values = {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "length": band(F.length(text), 200, 800, 3_200, 12_800),
        "capitals": band(share("[A-Z]"), 0.1, 0.4),
        "marks": band(share(r"[#*$%&|<>!]"), 0.01, 0.05),
        "lines": band(share("\n"), 0.002, 0.01),
    }
    return df.withColumns({"mix_tokens": F.size(common.words(text)).cast("long")} | {f"mix_{k}": F.coalesce(v.cast("string"), F.lit("")) for k, v in values.items()})


NAMES = [f"mix_{x}" for x in ("source", *EVIDENCE)]


def posteriors(cells: DataFrame, domain_col: str = "mix_source") -> tuple[DataFrame, list[str]]:
    """Cells with `p`, an array of posteriors in the order of the domains that are returned.

    The labelled table counts documents by evidence value and domain, from cells whose domain is known. A known domain is
    wrong with the chance NOISE. Cells with unknown domain get posteriors from their evidence alone. Without labelled rows
    there is no domain.
    """
    labelled = cells.filter(F.col(domain_col) != "")
    sizes = {r["d"]: r["n"] for r in labelled.groupBy(F.col(domain_col).alias("d")).agg(F.sum("n").alias("n")).collect()}  # a number a domain
    domains, total = sorted(sizes), sum(sizes.values())
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"{len(domains)} domains, more than {MOST_DOMAINS}: mix by a coarser column")
    if not domains:
        return cells.withColumn("p", F.array().cast("array<double>")), []
    long = F.explode(F.array(*[F.struct(F.lit(x).alias("f"), F.col(x).alias("v")) for x in NAMES if x != domain_col])).alias("x")
    seen = labelled.select(F.col(domain_col).alias("d"), "n", long).groupBy("x.f", "x.v", "d").agg(F.sum("n").alias("n"))
    seen = seen.groupBy("f", "v").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("seen"))
    size = F.create_map(*[F.lit(y) for d in domains for y in (d, log(sizes[d] + 32 * PRIOR))])
    names = F.array(*map(F.lit, domains))
    one = F.transform(names, lambda d: F.log(F.coalesce(F.col("seen")[d], F.lit(0)) + PRIOR) - size[d])
    parts = cells.select("cell", long).select("cell", "x.f", "x.v").filter("v != ''").join(seen, ["f", "v"]).select("cell", "f", one.alias("one"))
    scored = parts.select("cell", F.posexplode("one").alias("i", "s")).groupBy("cell", "i").agg(F.sum("s").alias("s"))
    prior = F.array(*[F.lit(log((sizes[d] + PRIOR) / (total + PRIOR * len(domains)))) for d in domains])
    scored = scored.select("cell", F.struct("i", (F.col("s") + F.get(prior, F.col("i"))).alias("s")).alias("s")).groupBy("cell").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["s"]).alias("s"))
    other = log(NOISE / max(1, len(domains) - 1))
    told = F.transform(names, lambda d: F.when(F.col(domain_col) == "", 0.0).when(F.col(domain_col) == d, log(1 - NOISE)).otherwise(other))
    scored = cells.select("cell", domain_col).join(scored, "cell").select("cell", F.zip_with("s", told, lambda a, b: a + b).alias("s"))
    raised = scored.select("cell", F.transform("s", lambda x: F.exp(x - F.array_max("s"))).alias("e"))
    shares = raised.select("cell", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))
    plain = F.transform(prior, lambda x: F.exp(x))
    return cells.join(shares, "cell", "left").withColumn("p", F.coalesce("p", plain)), domains


def rate(steps: list[list[float]], cap: float) -> Column:
    """The rate of a row with posteriors `p` after the steps: a fold of projected moves from 1."""
    if not steps:
        return F.lit(min(1.0, cap))
    table = F.array(*[F.array(*map(F.lit, s)) for s in steps])

    def move(r: Column, s: Column) -> Column:
        pull = F.aggregate(F.zip_with("p", s, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), r - pull))

    return F.aggregate(table, F.lit(float(min(1.0, cap))), move)


def solved(cells: DataFrame, domains: list[str], targets: dict[str, float] | None, tokens: float | None, cap: float) -> tuple[list[list[float]], dict[str, float]]:
    """Steps of the descent, and the wanted tokens of each domain.

    Errors are relative to a domain's expected tokens, which bounds the curvature by 1, so that a step of 1 descends.
    Without `tokens` the total for given targets is SLACK times the most for which no domain is asked for more than cap
    times what it has. The default targets share out all tokens there are (times the cap, if that is below 1), and a
    domain that has less than its share is asked for cap times what it has: how small it is does not change the rest.
    The descent ends where the targets are met, or where the caps leave nothing that moves.
    """

    def totals(r: Column) -> list[float]:
        found = cells.select(F.posexplode("p").alias("i", "p"), (F.col("tokens") * r).alias("t")).groupBy("i").agg(F.sum(F.col("p") * F.col("t")).alias("t")).collect()
        by = {x["i"]: x["t"] for x in found}
        return [float(by.get(i) or 0) for i in range(len(domains))]

    have = totals(F.lit(1.0))
    if not sum(have):
        return [], dict.fromkeys(domains, 0.0)
    wish = [max(0.0, (targets or {}).get(d, 0.0)) for d in domains] if targets else [(h / sum(have)) ** TEMPER for h in have]
    share = [w / (sum(wish) or 1) for w in wish]
    if tokens is None and not targets:
        want = [min(cap * h, min(1.0, cap) * sum(have) * s) for h, s in zip(have, share, strict=True)]
    else:
        total = tokens if tokens is not None else SLACK * min((cap * h / s for h, s in zip(have, share, strict=True) if s), default=0.0)
        want = [total * s for s in share]
    steps: list[list[float]] = []
    before = [float("inf")] * len(have)
    for _ in range(STEPS):
        got = totals(rate(steps, cap)) if steps else [h * min(1.0, cap) for h in have]
        step = [(g - w) / h if h else 0.0 for g, w, h in zip(got, want, have, strict=True)]
        still = all(abs(g - b) <= CLOSE / 10 * h for g, b, h in zip(got, before, have, strict=True))
        if max(map(abs, step)) < CLOSE or still:
            break
        steps.append(step)
        before = got
    return steps, dict(zip(domains, want, strict=True))


def mix(df: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None, cap: float = 1.0, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> tuple[DataFrame, dict[str, float]]:
    """df with mix_tokens, mix_domain, mix_posterior, mix_rate and mix_copies; and the wanted tokens of each domain.

    targets: relative weights of the domains, the values of `source`; the default tempers their shares, and domains that
    have less than their share are taken whole, up to the cap. A target without documents is left out. mix_copies is the rate's whole part plus one with the chance of the rest, by hashed id, so
    that equal ids have equal fates. Input columns of these names, or called mix_ and a name of EVIDENCE or source, are replaced
    or dropped. Null sources are unknown domains, other nulls are no evidence; null and empty texts
    have no tokens and the rate of their cell. Repeated rows count each. Other columns stay as they are.
    """
    spark = df.sparkSession
    rows = evidence(df.drop("mix_domain", "mix_posterior", "mix_rate", "mix_copies"), text_col)
    cells = rows.groupBy(*NAMES).agg(F.sum("mix_tokens").cast("double").alias("tokens"), F.count("*").alias("n"))
    cells = common.saved(spark, cells.withColumn("cell", F.xxhash64(*NAMES)), "cells")
    shared, domains = posteriors(cells)
    shared = common.saved(spark, shared.select(*NAMES, "tokens", "n", "p"), "shares")
    steps, want = solved(shared, domains, targets, tokens, cap)
    best = F.array_max("p")
    named = F.get(F.array(*map(F.lit, domains)), F.array_position("p", best).cast("int") - 1) if domains else F.lit(None).cast("string")
    rates = shared.select(*NAMES, named.alias("mix_domain"), best.alias("mix_posterior"), rate(steps, cap).alias("mix_rate"))
    if shared.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    out = rows.join(rates, NAMES, "left").drop(*NAMES)
    return out.withColumn("mix_copies", (F.floor("mix_rate") + (chance < F.col("mix_rate") - F.floor("mix_rate")).cast("int")).cast("int")), want


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out, _ = mix(docs)
    return out.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.col("mix_domain").alias("domain"), F.col("mix_posterior").alias("posterior"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, whole rows with any columns. The cap of 1 takes none twice."""
    common.tune(spark)
    out, _ = mix(docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("row")))
    return out.filter(F.col("mix_copies") > 0).select("row.*")


QUERIES = {"op1_mixing": op1_mixing}
SQL: dict[str, str] = {}
