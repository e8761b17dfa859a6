from pyspark.sql import functions as F

from weftwork.streaming import calls


def test_stream_of_calls(spark, tmp_path):
    rows = [(k, f"t{k % 3}", f"2024-01-01 00:{k:02d}:00") for k in range(12)]
    spark.createDataFrame(rows, "id long, name string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, name string, at timestamp").parquet(str(tmp_path / "in"))

    def drained(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["name"] for r in drained(calls.first_calls(stream, "name", "at"), "firsts")) == ["t0", "t1", "t2"]
    batch = spark.read.parquet(str(tmp_path / "in"))
    expected = calls.activity(batch, "name", "at").agg(F.sum("calls")).first()[0]
    assert expected == 12
    assert all(r["calls"] <= 2 for r in drained(calls.activity(stream, "name", "at"), "activity"))
