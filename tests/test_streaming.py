from braidflow.operators.ensemble import vector_stats
from braidflow.streaming.ensemble import running_stats, write_running_stats


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(60).selectExpr("id % 5 AS cell", "sin(id) AS u", "cos(id * 2) AS v")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_running_stats(running_stats(stream, ["cell"]), str(tmp_path / "out"), str(tmp_path / "at"), ["cell"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = got.join(got.groupBy("cell").agg({"n": "max"}).withColumnRenamed("max(n)", "n"), ["cell", "n"]).selectExpr("cell", "n", "round(u_mean, 9) u", "round(n_std, 9) s").distinct()
    want = vector_stats(rows, ["cell"]).selectExpr("cell", "n", "round(u_mean, 9) u", "round(n_std, 9) s")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
