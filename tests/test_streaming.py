"""Arriving records matched against a static index, as a stream."""

from ledgerlink.streaming import matching

SCHEMA = "m long, name_key string, ts timestamp"


def test_stream_against_static_index(spark, tmp_path):
    early = spark.createDataFrame([(1, "acme tools"), (2, "zeta foods")], "m long, name_key string").selectExpr("*", "timestamp '2024-01-01 10:05:00' AS ts")
    later = spark.createDataFrame([(3, "acme tools")], "m long, name_key string").selectExpr("*", "timestamp '2024-01-01 11:30:00' AS ts")
    early.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    later.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    index = spark.createDataFrame([(10, "acme tools"), (11, "acme tools")], "s1 long, name_key string")
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    matched = matching.match_stream(arriving, index, ["name_key"])
    rates = matching.match_rates(matched, "s1")
    runs = [
        matched.writeStream.format("memory").queryName("matched").option("checkpointLocation", f"{tmp_path}/c1").outputMode("append").trigger(availableNow=True).start(),
        rates.writeStream.format("memory").queryName("rates").option("checkpointLocation", f"{tmp_path}/c2").outputMode("complete").trigger(availableNow=True).start(),
    ]
    for run in runs:
        run.awaitTermination(120)
    assert sorted((r.m, r.s1 or 0) for r in spark.table("matched").collect()) == [(1, 10), (1, 11), (2, 0), (3, 10), (3, 11)]
    assert sorted((r.window.start.hour, r.n, r.n_matched) for r in spark.table("rates").collect()) == [(10, 3, 2), (11, 2, 2)]
