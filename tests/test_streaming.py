from pyspark.sql import functions as F

from tessera.streaming.incremental import link_stream, sessions, windowed_counts


def test_batches_get_their_pairs(spark, tmp_path):
    schema = "country string, uid long, src int, kt int, key string"
    ref = spark.createDataFrame([("us", 1, 0, "a"), ("us", 2, 0, "b")], "country string, uid long, kt int, key string")
    spark.createDataFrame([("us", 10, 2, 0, "a"), ("us", 11, 3, 0, "c")], schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([("us", 12, 2, 0, "b"), ("fr", 13, 2, 0, "b")], schema).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    got = []
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    link_stream(stream, ref, lambda df, n: got.extend((r.s1_uid, r.rec_uid) for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(got) == [(1, 10), (2, 12)]


def test_windows_and_sessions(spark):
    e = spark.createDataFrame([("2024-01-01 00:01:00", 1, "view", 2.0), ("2024-01-01 00:04:00", 1, "view", 3.0), ("2024-01-01 00:06:00", 2, "view", 1.0), ("2024-01-01 01:00:00", 1, "view", 1.0)], "ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.start.minute, r.n, r.total) for r in windowed_counts(e).collect()) == [(0, 1, 1.0), (0, 2, 5.0), (5, 1, 1.0)]
    assert sorted((r.user_id, r.n) for r in sessions(e).collect()) == [(1, 1), (1, 2), (2, 1)]
