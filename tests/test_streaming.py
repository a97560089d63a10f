from veridict.streaming import monitor


def test_stream_and_batch_agree(spark, tmp_path):
    rows = spark.sql("SELECT timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, IF(id % 2 = 0, 'warranted', 'overclaimed') AS gold, 'warranted' AS verdict FROM range(300)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = monitor.verdict_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(spark.table("counts").collect()) == sorted(monitor.verdict_counts(rows).collect())
