import datetime as dt

from tidemark.streaming import gate

T0 = dt.datetime(2026, 8, 15, 10)
KIND = "era int, target int, captured_at timestamp, events array<struct<period:int,is_next:boolean,cutoff:timestamp>>, source_id string"


def test_only_early_snapshots_pass(spark, tmp_path):
    calendar = spark.createDataFrame([(2026, 1, T0)], "era int, period int, cutoff timestamp")
    events = [(1, True, T0)]
    rows = [(2026, 1, T0 - dt.timedelta(hours=k), events, f"s{k}") for k in (3, 2, 0)]
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    q = gate.latest(stream, calendar).writeStream.outputMode("complete").format("memory").queryName("latest_snapshots").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("latest_snapshots").collect()] == [(2026, 1, T0 - dt.timedelta(hours=2), "s2")]
