from pyspark.sql import functions as F

from marginalia.streaming import first_seen, relink


def test_relink_and_first_seen(spark, tmp_path):
    source = tmp_path / "in"
    schema = "record string, ts timestamp, book_key string"
    spark.createDataFrame([("r1", "k1"), ("r1", "k1"), ("r2", "k2")], "record string, book_key string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).select("record", "ts", "book_key").write.parquet(str(source))
    books = spark.createDataFrame([("k1", "b1")], "book_key string, book_id string")
    stream = first_seen(spark.readStream.schema(schema).parquet(str(source)), ["record"], "ts", "1 day")
    run = relink(stream, books, lambda e, b: e.join(b, "book_key"), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r["record"], r["book_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("r1", "b1")]
