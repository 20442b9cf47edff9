import datetime

from quillspan.streaming import scores


def test_lines_of_all_batches_are_scored_once(spark, tmp_path):
    schema = "file string, text string, read string"
    for i in range(3):
        spark.createDataFrame([(f"f{i}", "дом", "дом"), (f"f{i}", "кот", "кит")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        scores.score_stream(stream, "text", "read", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and out.where("perfect").count() == 3


def test_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2025, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "a"), (at(3), "a"), (at(12), "b")], "t timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = scores.windowed_counts(stream, "t", "k", "10 minutes", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]
