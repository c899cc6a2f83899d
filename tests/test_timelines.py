"""Overlaps, patterns, reach, and streams that are joined or timed, against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarrystone import streaming
from quarrystone.operators.intervals import overlap_join, overlap_sums
from quarrystone.operators.patterns import match_rows
from quarrystone.operators.reach import hops
from quarrystone.plans import ORACLE_SQL, QUERIES, timelines
from quarrystone.streaming.joins import interval_join
from quarrystone.streaming.timers import merged, sessions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


SPANS = "id long, k string, s long, e long"


@pytest.mark.parametrize("hot_rows", [50_000, 3])
def test_overlaps_equal_all_pairs(spark, hot_rows):
    rng = random.Random(hot_rows)

    def span(i):
        s = rng.choice([rng.randint(-(10**7), 10**7), rng.randint(-(10**13), 10**13), 0, 1 << 22])
        return i, rng.choice(["a", "a", "a", "b", None]), s, s + rng.choice([0, 1, rng.randint(0, 10**6), rng.randint(0, 10**9), 1 << 40, -1])

    left = [span(i) for i in range(120)] + [(500, "a", None, 5), (501, "a", 5, None), (502, "a", -(1 << 61), 1 << 61), (7, "a", 0, 0), (7, "a", 0, 0)]
    right = [span(i) for i in range(90)] + [(600, "a", 0, 0), (601, "b", -(1 << 61), 1 << 61), (602, "a", None, None), (603, "a", 0, 0), (603, "a", 0, 0)]
    a, b = spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS)
    meet = lambda x, y: None not in (*x[2:], *y[2:]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    got = overlap_join(a, b, ["k"], ("s", "e"), ("s", "e"), hot_rows)
    assert got.columns == ["id", "k", "s", "e", "id_right", "k_right", "s_right", "e_right"]
    assert sorted((r.id, r.id_right) for r in got.collect()) == sorted((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and meet(x, y))
    every = overlap_join(a, b, [], ("s", "e"), ("s", "e"), hot_rows)
    assert sorted((r.id, r.id_right) for r in every.collect()) == sorted((x[0], y[0]) for x in left for y in right if meet(x, y))
    assert overlap_join(a.limit(0), b, ["k"], ("s", "e"), ("s", "e")).collect() == [] == overlap_join(a, b.limit(0), [], ("s", "e"), ("s", "e")).collect()


def test_overlaps_are_equi_joins(spark):
    for name in ("overlapping_orders", "sessions_around_signups"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hot_bin_is_cut(spark):
    a = spark.range(4000).selectExpr("id", "0L as s", "10L as e")
    b = spark.range(40).selectExpr("id", "5L as s", "5L as e")
    pairs = overlap_join(a, b, [], ("s", "e"), ("s", "e"), hot_rows=500)
    assert pairs.count() == 160_000
    # The left rows of the one bin lie in eight chunks.
    chunks = a.select(F.pmod(F.xxhash64(F.struct("id", "s", "e")), F.lit(8)).alias("c")).groupBy("c").count().collect()
    assert len(chunks) == 8 and max(r["count"] for r in chunks) < 4000 / 3


def test_overlap_sums_equal_all_pairs(spark):
    rng = random.Random(8)
    span = lambda s: (s, s and s + rng.choice([0, 0, 1, rng.randint(0, 40), -1]))
    left = [(i, *span(rng.choice([None, 0, rng.randint(-99, 99)]))) for i in range(150)] + [(7, 5, 5), (7, 5, 5), (8, 5, None), (9, -(1 << 61), 1 << 61)]
    right = [(rng.choice([None, 1, 2, -3]), *span(rng.choice([None, 0, rng.randint(-99, 99)]))) for _ in range(120)] + [(2, 5, 5), (2, 5, 5), (4, 5, None)]
    a, b = spark.createDataFrame(left, "id long, s long, e long").repartition(3), spark.createDataFrame(right, "w int, s long, e long").repartition(2)
    met = lambda x: [y[0] for y in right if None not in (*x[1:], *y[1:]) and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]]
    want = sorted(((*x, len(m), sum(w or 0 for w in m)) for x in left for m in [met(x)]), key=str)
    weights = {"n": F.lit(1), "w": F.col("w")}
    got = overlap_sums(a, b, ("s", "e"), ("s", "e"), weights)
    assert got.columns == ["id", "s", "e", "n", "w"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert [tuple(r) for r in overlap_sums(a.where("e - s > 1000"), b.limit(0), ("s", "e"), ("s", "e"), weights).collect()] == [(9, -(1 << 61), 1 << 61, 0, 0)]
    assert overlap_sums(a.limit(0), b, ("s", "e"), ("s", "e"), weights).collect() == []


def test_signups_of_odd_events(spark, oracle, tmp_path, monkeypatch):
    """Repeated, missing and far-apart signups of an event_id, users and times that are not known."""
    rng = random.Random(4)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=round(60 * h))
    rows = [(1000 + i, at(rng.uniform(0, 200)), rng.choice([1, 2, 3, 4, None]), rng.choice(["view", "signup"])) for i in range(160)]
    rows += [(i, at(rng.choice([0, 1, 2, 6, 7, 8, 60, 61])), rng.choice([1, 2, None]), "signup") for i in [1, 2, 3, 4, None, None] for _ in range(rng.choice([1, 2, 4]))] + [(5, None, 1, "signup"), (2, None, 2, "signup"), (6, at(3), 1, "signup"), (6, at(3), 1, "signup")]
    rows += [(7, at(30 + h), None, "signup") for h in range(9)] + [(8, at(h), 9, "signup") for h in (400, 406, 412.5)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").repartition(3)
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    joined, join = [], timelines.overlap_join
    monkeypatch.setattr(timelines, "overlap_join", lambda left, *a, **k: joined.extend(r.event_id for r in left.collect()) or join(left, *a, **k))
    got = QUERIES["sessions_around_signups"](spark, str(tmp_path)).select("event_id", "sessions", "users").collect()
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql/events.parquet").symlink_to(next((tmp_path / "events.parquet").glob("part-*")))
    assert sorted(map(tuple, got), key=str) == sorted(oracle(ORACLE_SQL["sessions_around_signups"], str(tmp_path / "sql"))[1], key=str)
    # Pairs are made for what covers far-apart hours alone.
    assert joined and not {x for x in joined if x and x >= 1000}


def brute_matches(rows, steps, within, others_break):
    """Every start is tried; a match takes what each step must, in order."""
    found = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[2] is not None and r[1] is not None), key=lambda r: (r[2], r[1], r[3]))
        own = [r for r in own if others_break or r[3]]
        for i in range(len(own)):
            at = i
            for kind, repeats in steps:
                n = 0
                while at < len(own) and own[at][3] == kind and (repeats or n == 0):
                    at, n = at + 1, n + 1
                if n == 0:
                    break
            else:
                if own[at - 1][2] - own[i][2] <= within:
                    found.append((key, own[i][1], own[at - 1][1], at - i))
    return found


@pytest.mark.parametrize("others_break", [True, False])
@pytest.mark.parametrize("chunk", [10**12, 40, 3])
def test_patterns_equal_brute_force(spark, chunk, others_break):
    rng = random.Random(chunk)
    rows = [(rng.choice(["u", "u", "v", None]), i, rng.choice([rng.randint(0, 600), rng.randint(-50, 50), None]), rng.choice([0, 1, 2, 2, 3, 3, 4])) for i in range(900)]
    rows += [("w", 2000 + i, i, k) for i, k in enumerate([1, *[2] * 300, 3, 4, 1, 2, 3])] + [(None, None, 5, 1)]
    df = spark.createDataFrame(rows, "k string, id long, t long, kind int").repartition(3)
    for wanted, within in (([(1, False), (2, True), (3, False)], 200), ([(1, False), (3, False)], 10**9), ([(1, False), (2, True), (3, True), (4, False)], 10**9)):
        kinds = {kind for kind, _ in wanted}
        known = [(*r[:3], r[3] if r[3] in kinds else 0) for r in rows]
        got = match_rows(df, ["k"], "t", "id", [(F.col("kind") == kind, repeats) for kind, repeats in wanted], within, others_break, chunk)
        assert got.columns == ["k", "first_id", "last_id", "started", "ended", "n_rows"]
        assert sorted(((r.k, r.first_id, r.last_id, r.n_rows) for r in got.collect()), key=str) == sorted(brute_matches(known, wanted, within, others_break), key=str)


def test_patterns_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 2, dt.datetime(2024, 1, 1), "a"), (1, 3, dt.datetime(2024, 1, 2), "b"), (1, 3, dt.datetime(2024, 1, 2), "b")], "k int, id int, t timestamp_ntz, kind string")
    steps = [(F.col("kind") == "a", False), (F.col("kind") == "b", False)]
    assert [tuple(r) for r in match_rows(df, ["k"], "t", "id", steps).collect()] == [(1, 2, 3, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 2)]
    assert match_rows(df.limit(0), ["k"], "t", "id", steps).collect() == []
    with pytest.raises(ValueError, match="single rows"):
        match_rows(df, ["k"], "t", "id", [(F.col("kind") == "a", True), (F.col("kind") == "b", False)])


def test_hops_equal_a_search(spark):
    rng = random.Random(5)
    members = [(rng.randint(0, 150), rng.randint(0, 130)) for _ in range(260)] + [(1, None), (None, 1), (1, 1), (1, 1), (1000, 999)] + [(2000 + i, 5000) for i in range(50)] + [(3, 5000)]
    sources = [(1,), (7,), (None,), (1,), (9999,)]
    at = {1: 0, 7: 0, 9999: 0}
    front = set(at)
    while front:
        groups = {g for n, g in members if n in front and g is not None}
        step = 1 + max(at[n] for n in front)
        front = {n for n, g in members if g in groups and n is not None and n not in at}
        at |= {n: step for n in front}
    df, of = spark.createDataFrame(members, "node long, group long"), spark.createDataFrame(sources, "node long")
    assert dict(map(tuple, hops(df, of).collect())) == at and max(at.values()) > 3
    assert dict(map(tuple, hops(df.limit(0), of).collect())) == {1: 0, 7: 0, 9999: 0}
    assert hops(df, of.limit(0)).collect() == []
    with pytest.raises(RuntimeError, match="rounds"):
        hops(df, of, most_rounds=2)


EVENTS = "id long, user_id long, ts timestamp"


def put(spark, path, rows):
    data = [(i, u, m and dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for i, u, m in rows]
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(path)


def state_rows(query):
    return sum(s["numRowsTotal"] for s in (query.lastProgress or {}).get("stateOperators", []))


def test_stream_join_late_rows_and_state(spark, tmp_path):
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    put(spark, left, [(1, 1, 600), (2, 2, 610), (3, None, 600), (4, 1, 600)])
    put(spark, right, [(11, 1, 570), (12, 1, 540), (13, 1, 539), (14, 2, 611), (15, None, 590), (11, 1, 570)])
    stream = lambda path, name: spark.readStream.schema(EVENTS).parquet(path).withColumnRenamed("id", name)
    found = interval_join(stream(left, "a"), stream(right, "b"), ["user_id"], "ts", "60 MINUTES", late="30 minutes")
    seen, states = [], []

    def run():
        query = found.writeStream.foreachBatch(lambda batch, _: seen.extend((r.a, r.b) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(state_rows(query))

    run()
    assert sorted(seen, key=str) == sorted([(1, 11), (1, 11), (1, 12), (4, 11), (4, 11), (4, 12)], key=str)
    put(spark, left, [(5, 1, 6000)])
    put(spark, right, [(16, 1, 5990)])
    run()
    # The rows of the first day part can meet nothing any more: those unmatched are given, and their state goes.
    assert sorted(seen[6:], key=str) == sorted([(5, 16), (2, None), (3, None)], key=str)
    put(spark, left, [(6, 1, 615), (7, 9, 6100)])  # 615 is older than the watermark
    put(spark, right, [(17, 1, 600), (18, 9, 6101)])
    run()
    assert not [x for x in seen if 6 in x or 17 in x]
    assert states[1] < states[0] and states[2] <= states[0]


def test_stream_join_of_empty_streams(spark, tmp_path):
    for side in "lr":
        spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / side))
    stream = lambda side, name: spark.readStream.schema(EVENTS).parquet(str(tmp_path / side)).withColumnRenamed("id", name)
    assert streaming.drain(interval_join(stream("l", "a"), stream("r", "b"), ["user_id"], "ts", "1 HOUR"), "append").collect() == []


def test_merged_runs():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randint(0, 60) for _ in range(rng.randint(0, 12))]
        want = []
        for t in sorted(times):
            if want and t - want[-1][1] < 5:
                want[-1] = (want[-1][0], t, want[-1][2] + 1)
            else:
                want.append((t, t, 1))
        cut = rng.randint(0, len(times))
        assert merged(merged([(t, t, 1) for t in times[:cut]], 5) + [(t, t, 1) for t in times[cut:]], 5) == want


def test_timed_sessions_stop_and_resume(spark, tmp_path):
    """Batches of one file each, a stop in between, rows out of order, late ones, and ones that join two sessions."""
    own = streaming.stateful_session(spark)
    path, state, out = str(tmp_path / "in"), str(tmp_path / "state"), []
    put(spark, path, [])
    source = own.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    hour = 60

    def run():
        query = sessions(source, gap_hours=2, late="1 hour").writeStream.foreachBatch(lambda batch, _: out.extend(map(tuple, batch.collect()))).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    put(spark, path, [(1, 1, 10 * hour), (2, 1, 12 * hour + 20), (3, 2, 10 * hour), (4, None, 10 * hour), (5, 3, None)])
    run()
    assert out == []
    put(spark, path, [(6, 1, 12 * hour - 30), (7, 1, 12 * hour - 30), (8, 2, 12 * hour)])  # 11:30 joins 10:00 and 12:20; 12:00 is a gap after 10:00
    run()
    assert out == []
    put(spark, path, [(9, 2, 16 * hour)])  # the watermark goes to 15:00
    run()
    micros = lambda m: int((dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)).timestamp()) * 10**6
    want = [(1, micros(600), micros(740), 4), (2, micros(600), micros(600), 1), (2, micros(720), micros(720), 1)]
    assert sorted(out) == want
    put(spark, path, [(10, 1, 14 * hour), (11, 3, 40 * hour)])  # 14:00 is late
    run()
    run()
    assert sorted(out) == sorted([*want, (2, micros(960), micros(960), 1)])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != streaming.ROCKS


def test_a_closing_row_closes_what_is_open(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, [(1, 1, 10), (2, 1, 50), (3, 2, 70)])
    stream, close = streaming.with_closing(spark.readStream.schema(EVENTS).parquet(path).withColumn("event_type", F.lit("x")))
    counts = streaming.tumbling_counts(stream)
    assert streaming.drain(counts, "append").collect() == []
    out = streaming.drain(counts, "append", close)
    assert sorted((r.start.hour, r.n) for r in out.collect()) == [(0, 2), (1, 1)]
