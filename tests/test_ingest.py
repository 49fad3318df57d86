"""A stream that is stopped and goes on gives the table of the batches; a batch that runs twice counts once."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.sources.tables import replace_by_key
from corpusloom.streaming import ingest, state


def _rows(spark, rows):
    return spark.createDataFrame(rows, "url string, chunk int, content string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))


def test_stream_equals_batches_after_a_restart(spark, tmp_path):
    from datetime import datetime, timedelta

    day = datetime(2024, 1, 1)
    batches = [
        [("a", 0, "old", day), ("a", 1, "old", day), ("b", 0, "b", day), (None, 0, "none", day)],
        [("a", 0, "new", day + timedelta(minutes=5)), ("c", 0, "c", day)],
        [("b", 0, "b2", day), ("b", 1, "b3", day), (None, 0, "none2", day)],
    ]
    want, source = None, f"{tmp_path}/in"
    schema = _rows(spark, batches[0]).schema
    for no, rows in enumerate(batches):
        given = _rows(spark, rows)
        given.coalesce(1).write.mode("append").parquet(source)
        # each round is a new run that goes on from the checkpoint
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.ingest(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
        known = given.where("url IS NOT NULL")
        want = known if want is None else replace_by_key(want, known, "url")
        got = ingest.current(spark, f"{tmp_path}/table", schema, ["url"])
        assert sorted(got.where("url IS NOT NULL").collect()) == sorted(want.collect())
        assert [r["content"] for r in got.where("url IS NULL").collect()] == ["none2" if no == 2 else "none"]
    before = sorted(map(repr, got.collect()))
    # the last batch again, as after a loss between its write and its commit
    _rows(spark, batches[2]).write.mode("overwrite").parquet(f"{tmp_path}/table/batch=2")
    again = ingest.compact(spark, f"{tmp_path}/table", f"{tmp_path}/compact", schema, ["url"])
    assert sorted(map(repr, again.collect())) == before and again.count() == 5


def test_duplicates_go_within_the_watermark(spark, tmp_path):
    from datetime import datetime, timedelta

    day, source = datetime(2024, 1, 1), f"{tmp_path}/in"
    schema = _rows(spark, [("a", 0, "x", day)]).schema
    for no, rows in enumerate([[("a", 0, "first", day), ("a", 0, "first", day)], [("a", 0, "second", day + timedelta(minutes=1)), ("b", 0, "b", day)]]):
        _rows(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.first_seen(spark.readStream.schema(schema).parquet(source), ["url"], "at")
        ingest.ingest(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/table")
        assert sorted((r["url"], r["content"]) for r in got.collect()) == [("a", "first"), ("b", "b")][: no + 1]


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changed = state.windowed(stream, late="60 days")
    ingest.ingest(changed, f"{tmp_path}/table", f"{tmp_path}/checkpoint", mode="update").awaitTermination()
    rounded = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 4)) for r in df.collect())
    assert rounded(ingest.current(spark, f"{tmp_path}/table", changed.schema, ["start", "event_type"])) == rounded(state.windowed(events))
