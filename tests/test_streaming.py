from __future__ import annotations

import datetime as dt

from quarrystone import streaming


def put(spark, path, name, rows):
    data = [(i, dt.datetime(2024, 1, 1, h, m), kind) for i, h, m, kind in rows]
    spark.createDataFrame(data, "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    put(spark, path, "a", [(1, 1, 0, "x"), (2, 1, 30, "x"), (3, 2, 10, "x")])
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(path)
    counts = streaming.tumbling_counts(stream, late="1 hour")

    def run():
        query = counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    put(spark, path, "b", [(4, 6, 0, "x")])
    run()
    put(spark, path, "c", [(5, 1, 45, "x"), (6, 9, 0, "x")])  # 01:45 is older than the watermark of 05:00
    run()
    got = {r.start.hour: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 2, 2: 1, 6: 1}


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, "a", [(1, 1, 0, "x"), (1, 1, 20, "x"), (2, 1, 0, "y"), (2, 1, 0, "y")])
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(path)
    out = streaming.drain(streaming.first_of_each(stream, ["event_id"]), mode="append")
    assert sorted(r.event_id for r in out.collect()) == [1, 2]


def test_stream_times_are_utc_in_any_zone(spark):
    from conftest import SF

    from quarrystone.plans import QUERIES

    want = sorted(map(tuple, QUERIES["streamed_hourly_events"](spark, SF).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, QUERIES["streamed_hourly_events"](spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_is_kept_between_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for name, rows in (("a", [(1, "purchase", 1.0), (2, "purchase", 2.0), (1, "view", 9.0)]), ("b", [(1, "purchase", 0.5), (None, "purchase", 1.0), (3, "purchase", None)])):
        spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKS)
    try:
        out = streaming.drain(streaming.purchases(stream), mode="update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    best = {}
    for r in out.collect():
        best[r.user_id] = max(best.get(r.user_id, (0, 0)), (r.n, r.cents))
    assert best == {1: (2, 150), 2: (1, 200), 3: (1, 0)}
