"""The text functions where the whole job is more than the common case: texts of any length."""

import pytest
from pyspark.sql import functions as F

from veilscope.functions import text as T

LONG = 300_000


@pytest.mark.parametrize("a, b, prefix, suffix", [("x" * LONG, "x" * LONG + "\u202e", LONG, 0), ("y" + "x" * LONG, "z" + "x" * LONG, 0, LONG), ("x" * LONG + "ab", "x" * LONG + "cb", LONG, 1)])
def test_prefix_and_suffix_of_long_texts(spark, a, b, prefix, suffix):
    df = spark.createDataFrame([(a, b)], "a string, b string").withColumn("p", T.common_prefix(F.col("a"), F.col("b")))
    row = df.withColumn("s", T.common_suffix(F.col("a"), F.col("b"), F.col("p"))).first()
    assert (row["p"], row["s"]) == (prefix, suffix)
