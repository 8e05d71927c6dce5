import time

import pytest

from veilscope.functions import unicode_tables as U
from veilscope.streaming import detect_stream


def test_finding_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a\u200bb"), (2, "clean")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = detect_stream.findings(stream, dict(zip(*U.COMPACT))).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [r["category"] for r in spark.table("found").collect()] == ["invisible-unicode"]


def test_chunk_stream(spark, tmp_path):
    schema = "doc_id long, seq long, chunk binary, last boolean"
    batches = [[(1, 1, b"et", True), (2, 0, b"x" * 20, False)], [(1, 0, b"tick", False), (2, 1, b"y", True), (1, 0, b"tick", False), (3, 0, b"open", False)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = detect_stream.assembled(stream, 10).writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 90  # a processing-time timeout keeps the stream at work, so that it never idles
    while spark.table("whole").count() < 2 and time.time() < until:
        time.sleep(1)
    query.stop()
    rows = {r["doc_id"]: r for r in spark.table("whole").collect()}
    assert sorted(rows) == [1, 2] and bytes(rows[1]["content"]) == b"ticket" and rows[1]["complete"]
    assert rows[2]["content"] is None and not rows[2]["complete"] and rows[2]["byte_length"] == 21
    with pytest.raises(KeyError):
        rows[3]
