from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import streaming
from graphloom.sources import nquads


def test_distinct_quads_are_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.nq").write_text("<http://e/a> <http://e/p> <http://e/b> .\n<http://e/a> <http://e/q> \"x\" .\noops\n")
    quads = nquads.read_stream(spark, str(tmp_path / "in")).withColumn("time", F.current_timestamp())
    for _ in range(2):  # the second run finds nothing new
        query = streaming.write_lines(streaming.distinct(quads, "time"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(90)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['<http://e/a> <http://e/p> <http://e/b> .', '<http://e/a> <http://e/q> "x" .']


def test_counts_per_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nq").write_text("<http://e/a> <http://e/p> <http://e/b> .\n<http://e/c> <http://e/p> <http://e/b> .\n")
    quads = nquads.read_stream(spark, str(tmp_path / "in")).withColumn("time", F.lit("2024-01-01 00:00:30").cast("timestamp"))
    query = streaming.counts(quads, "time").writeStream.format("memory").queryName("window_counts").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert [(str(r.start), r.p, r.n) for r in spark.table("window_counts").collect()] == [("2024-01-01 00:00:00", "http://e/p", 2)]
