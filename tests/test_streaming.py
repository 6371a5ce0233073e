from pyspark.sql import functions as F

from textloom.streaming.cache import serve, windowed_stats


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_cache_state_spans_batches(spark, tmp_path):
    rows = [("a", 1, 1, [1.0, 0.0]), ("a", 2, 2, [1.0, 0.01]), ("b", 3, 3, [1.0, 0.0]), ("a", 4, 4, [0.0, 1.0])]
    schema = "epoch string, seq int, id bigint, vec array<double>"
    for i in range(0, 4, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.id: (r.hit, r.matched) for r in drain(serve(stream), "decisions", "append").collect()}
    assert set(got) == {1, 2, 3, 4} and sum(h for h, _ in got.values()) == 1 and not got[3][0]


def test_windows_count_repeats_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", True), (1, "2024-01-01 00:10:00", True), (2, "2024-01-01 00:20:00", False), (3, "2024-01-01 02:00:00", True)]
    df = spark.createDataFrame(rows, "request_id bigint, asked_at string, cache_hit boolean").withColumn("asked_at", F.to_timestamp("asked_at"))
    df.write.parquet(str(tmp_path / "log"))
    want = {(0, 2, 1), (2, 1, 1)}
    shape = lambda d: {(r.start.hour, r.requests, r.hits) for r in d.collect()}
    assert shape(windowed_stats(df)) == want
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    assert shape(drain(windowed_stats(stream), "windows", "complete")) == want
