from pyspark.sql import functions as F

from wayline.streaming.arrivals import sessions, window_counts


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 37).alias("ts"), (F.col("id") % 3).alias("key"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = window_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = window_counts(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))
    assert sum(r.n for r in sessions(rows).collect()) == 200
