"""Streams give the rows of the same query over the whole table."""

from docflow.streaming import activity_windows, user_sessions

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drained(spark, stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append" if name == "sessions" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_streams(spark, tmp_path):
    table = spark.read.parquet(EVENTS)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    rows = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert rows(drained(spark, activity_windows(stream), tmp_path, "windows")) == rows(activity_windows(table))
    whole = {(r["user_id"], r["start"], r["end"], r["n"]) for r in user_sessions(table).collect()}
    assert sum(r[3] for r in whole) == table.count()
    assert {(r["user_id"], r["start"], r["end"], r["n"]) for r in drained(spark, user_sessions(stream), tmp_path, "sessions").collect()} <= whole
