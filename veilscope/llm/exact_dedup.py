"""Exact deduplication by skew-safe combining.

Equal texts are combined three times: inside each input partition (the map side of the first aggregation), inside each
salted digest group, and across the salts of a digest, where only the winner of each salt and its count go. Full content is
part of the key at every stage, so that a digest collision never merges two texts. A text with any number of copies costs
one row for each input partition in the first shuffle and one for each salt in the second; the ids of its copies stay in
their salted groups, which get the result by a join on the group's own number. Where only the rows that stay are wanted, they
go through the same three steps and no ids are listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{common.SPACE}+", "")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest: Callable[[Column], Column] = sha256, whole: bool = False) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, and the digest of the normalised text as text_sha256.
    whole: the rows of df that stay instead, with all their columns, one for each text.

    Normalising deletes the characters of common.SPACE; null counts as empty, so that null, empty and blank texts are
    one group. The row with the most code points, then the smallest id stays. A null id loses every tie. Where a row
    repeats the id of the one that stays, one of them is kept. Ids are whole numbers. Other columns are not read, but with whole. An empty table gives none.
    """
    spark = df.sparkSession
    salts = salts or common.partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.length(text).alias("size"), normalised(F.col(text_col)).alias("content"), *[F.struct(*df.columns).alias("row")] * whole)
    rows = rows.select("*", digest(F.col("content")).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    order = F.struct("size", F.bitwise_not("id").alias("first"))  # ~id falls as id rises, without overflow
    best = F.max(order).alias("best")
    if whole:
        groups = rows.groupBy("digest", "salt", "content").agg(best, F.max_by("row", order).alias("row"))
        winners = groups.select("digest", "best", "row").repartition("digest")  # without the content, which the row gives again
        winners = winners.select("*", normalised(F.col("row")[text_col]).alias("content"))
        return winners.groupBy("digest", "content").agg(F.max_by("row", "best").alias("row")).select("row.*")
    groups = rows.groupBy("digest", "salt", "content").agg(F.collect_list(F.struct("id")).alias("members"), best)
    groups = common.saved(spark, groups.withColumn("group", F.monotonically_increasing_id()), "groups")
    common.collected(spark)  # nothing refers to the first shuffle any more
    same = Window.partitionBy("digest", "content")
    winners = groups.select("group", "digest", "content", "best", "salt", F.size("members").alias("n"))
    winners = winners.select(
        "group",
        F.bitwise_not(F.max("best").over(same)["first"]).alias("keep_id"),
        F.sum("n").over(same).cast("long").alias("group_size"),
        (F.row_number().over(same.orderBy(F.col("best").desc(), F.col("salt"))) == 1).alias("has_best"),
    )
    found = groups.select("group", "digest", "members").join(winners, "group")
    at = F.coalesce(F.array_position(F.transform("members", lambda m: m["id"]), F.col("keep_id")), F.lit(1)) - 1
    out = found.select("*", at.alias("at")).select("*", F.posexplode("members").alias("pos", "member"))
    return out.select(F.col("member.id").alias(id_col), "keep_id", "group_size", (F.col("has_best") & (F.col("pos") == F.col("at"))).alias("kept"), F.col("digest").alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, as whole rows, so that ids may be null or repeat: each text has one row afterwards."""
    common.tune(spark)
    return exact_dedup(docs, whole=True)


_SQL = r"""
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(content) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS size,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents)
WINDOW w AS (PARTITION BY content ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
SQL = {"op3_exact_dedup": _SQL}
