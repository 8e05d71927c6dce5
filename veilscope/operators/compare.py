"""Views of a text, their pairwise comparison, and materiality by boundary, all inside the row."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .detect import MATERIALITY, SEVERITY, level, named, once

# The boundary of two views, and the categories that are evidence for it.
BOUNDARIES = {
    ("human_projection", "machine"): ("visibility", ["ascii-smuggling", "bidi-reordering", "hidden-html-css", "invisible-unicode"]),
    ("browser_inner_text", "human_projection"): ("rendering", ["hidden-html-css", "render-observer-divergence"]),
    ("machine", "tag_stripped"): ("hidden-tag", ["ascii-smuggling", "unicode-tag-sequence"]),
    ("machine", "nfkc"): ("normalization", ["normalization"]),
    ("confusable_skeleton", "machine"): ("identity", ["confusable-homoglyph"]),
}
COMPARED = ["relation", "left_sha256", "right_sha256", "left_length", "right_length", "length_delta", "prefix", "suffix", "first_difference", "left_start", "left_end", "right_start", "right_end", "left_fragment", "right_fragment"]


def view_columns(docs: DataFrame, forms: Column) -> dict[str, Column]:
    """The views by name. forms: nfc, nfkc, skeleton. `html` and `browser_text` are used where they are columns."""
    text = F.col("text")
    human = F.coalesce("html.visible", T.human_projection(text)) if "html" in docs.columns else T.human_projection(text)
    views = {"machine": text, "human_projection": human, "nfc": forms["nfc"], "nfkc": forms["nfkc"], "tag_stripped": T.tag_stripped(text), "confusable_skeleton": forms["skeleton"]}
    if "browser_text" in docs.columns:
        views["browser_inner_text"] = F.col("browser_text")
    return views


def with_views(docs: DataFrame, table: dict[str, str]) -> DataFrame:
    """docs with one column for each view, prefixed `view_`."""
    rows = T.with_forms(docs, table, F.col("text"))
    return rows.withColumns({f"view_{k}": v for k, v in view_columns(docs, F.col("forms")).items()}).drop("forms")


def names(viewed: DataFrame) -> list[str]:
    return sorted(c.removeprefix("view_") for c in viewed.columns if c.startswith("view_"))


def long_views(viewed: DataFrame) -> DataFrame:
    """doc_id, view, text, sha256, len."""
    some = F.array(*[F.struct(F.lit(n).alias("view"), F.col(f"view_{n}").alias("text")) for n in names(viewed)])
    return viewed.select("doc_id", F.explode(some).alias("v")).select("doc_id", "v.view", "v.text").filter("text IS NOT NULL").withColumns({"sha256": T.sha256(F.col("text")), "len": F.length("text")})


def comparisons(viewed: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each pair of views, names in order: relation, digests, lengths, and where the difference lies.

    Pairs are made inside the row, without a join; each view is hashed and measured once. Equal pairs have no first
    difference and no delta. A view that is null has no pairs.
    """
    pairs = pairs or list(combinations(names(viewed), 2))
    used = sorted({x for p in pairs for x in p})
    rows = viewed.select("doc_id", *[once(F.col(f"view_{x}")).alias(f"view_{x}") for x in used], *[once(T.sha256(F.col(f"view_{x}"))).alias(f"hash_{x}") for x in used])
    some = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), *[F.col(f"{p}_{x}").alias(n) for x, s in ((a, "a"), (b, "b")) for p, n in (("view", s), ("hash", f"hash_{s}"))]) for a, b in pairs])
    rows = rows.select("doc_id", F.explode(some).alias("p")).select("doc_id", "p.*").filter("a IS NOT NULL AND b IS NOT NULL")
    rows = rows.withColumn("equal", F.col("hash_a") == F.col("hash_b"))
    rows = rows.withColumn("prefix", F.when(F.col("equal"), F.length("a")).otherwise(T.common_prefix(F.col("a"), F.col("b"))))
    rows = rows.withColumn("suffix", F.when(F.col("equal"), 0).otherwise(T.common_suffix(F.col("a"), F.col("b"), F.col("prefix"))))
    sides = {}
    for side, text in (("left", "a"), ("right", "b")):
        end = F.length(text) - F.col("suffix")
        sides |= {f"{side}_sha256": F.col(f"hash_{text}"), f"{side}_length": F.length(text)}
        sides |= {f"{side}_start": F.when(~F.col("equal"), F.col("prefix")), f"{side}_end": F.when(~F.col("equal"), end), f"{side}_fragment": F.when(~F.col("equal"), T.fragment(F.col(text), F.col("prefix"), end))}
    rows = rows.withColumns({"relation": F.when(F.col("equal"), "agreement").otherwise("divergence"), "first_difference": F.when(~F.col("equal"), F.col("prefix")), "length_delta": F.length("b") - F.length("a")} | sides)
    return rows.select("doc_id", "left", "right", "equal", *COMPARED)


def edges_of(views: dict[str, Column], found: Column) -> Column:
    """An array of edges, one for each boundary whose two views are there, from the views and the findings of a row.

    An edge takes the findings of the rule's categories. Where the views differ and one is the machine's text, only
    findings that overlap the changed middle, or that have no place, count.
    """
    here = {k: v for k, v in BOUNDARIES.items() if k[0] in views and k[1] in views}
    return F.filter(F.array(*[_edge(pair, rule, views, found) for pair, rule in here.items()]), lambda e: e.isNotNull())


def _edge(pair: tuple[str, str], rule: tuple[str, list[str]], views: dict[str, Column], found: Column) -> Column:
    """The edge of two views; null if one is not there."""
    x, y = views[pair[0]], views[pair[1]]
    differs = x != y
    machine = views["machine"] if "machine" in pair else None
    relevant = F.filter(found, lambda f: f["category"].isin(rule[1]))

    def overlapping(p: Column, end: Column) -> Column:
        return F.filter(relevant, lambda f: f["start"].isNull() | f["end"].isNull() | ((f["start"] < end) & (f["end"] > p)))

    def edge(p: Column) -> Column:
        """p: the common prefix; null where the views agree."""
        own = relevant
        if machine is not None:
            end = F.length(machine) - T.common_suffix(x, y, p)
            placed = F.exists(relevant, lambda f: f["start"].isNotNull())  # else there is nothing to leave out
            own = F.when(differs & placed, F.transform(F.array(end), lambda e: overlapping(p, e))[0]).otherwise(relevant)
        most = F.aggregate(own, F.lit(0), lambda m, f: F.greatest(m, level(f["materiality"], MATERIALITY)))
        parts = {"left": F.lit(pair[0]), "right": F.lit(pair[1]), "boundary": F.lit(rule[0]), "relation": F.when(differs, "divergence").otherwise("agreement")}
        parts |= {"materiality": F.when(~differs, "none").otherwise(named(F.greatest(most, F.lit(1)), MATERIALITY)), "own": own, "first_difference": p}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    made = F.transform(F.array(F.when(differs, T.common_prefix(x, y))), edge)
    kept = ["left", "right", "boundary", "relation", "materiality"]
    done = F.transform(made, lambda e: F.struct(*[e[k].alias(k) for k in kept], _distinct(e["own"], "category").alias("evidence_categories"), _distinct(e["own"], "id").alias("finding_ids"), e["first_difference"].alias("first_difference")))
    return F.when(x.isNotNull() & y.isNotNull(), done[0])


def _distinct(found: Column, field: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda f: f[field])))


def radial_of(edges: Column) -> Column:
    """disposition, material, divergent, agreeing, promoted, boundaries: the rollup of a row's edges."""
    most = F.aggregate(edges, F.lit(0), lambda m, e: F.greatest(m, level(e["materiality"], MATERIALITY)))
    differs = F.filter(edges, lambda e: e["relation"] == "divergence")
    parts = {"disposition": named(most, MATERIALITY), "material": most >= 2, "divergent": F.size(differs), "agreeing": F.size(edges) - F.size(differs)}
    parts |= {"promoted": F.size(F.filter(edges, lambda e: level(e["materiality"], MATERIALITY) >= 2)), "boundaries": F.array_sort(F.array_distinct(F.transform(differs, lambda e: e["boundary"])))}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def summary_of(found: Column) -> Column:
    """finding_count, severity, material_divergence, categories of an array of findings."""
    most = F.aggregate(found, F.lit(0), lambda m, f: F.greatest(m, level(f["severity"], SEVERITY)))
    material = F.exists(found, lambda f: f["materiality"].isin(MATERIALITY[2:]))
    return F.struct(F.size(found).alias("finding_count"), named(most, SEVERITY).alias("severity"), material.alias("material_divergence"), F.array_sort(F.array_distinct(F.transform(found, lambda f: f["category"]))).alias("categories"))


def lookalikes(docs: DataFrame, skeleton: Column, name_col: str = "text") -> DataFrame:
    """doc_id_a, doc_id_b: different names with one skeleton, joined on the skeleton; a hub joins each of a group to the smallest id."""
    rows = docs.select("doc_id", F.col(name_col).alias("name"), skeleton.alias("skeleton"))
    first = rows.groupBy("skeleton").agg(F.min(F.struct("doc_id", "name")).alias("first"))
    pairs = rows.join(first, "skeleton").filter("first.name <> name")
    return pairs.select(F.col("first.doc_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
