"""Mergeable counts, frequent keys, regular series, variants, stored layouts and functions in Python."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarrystone.functions.python import Balance, edit_distance, products_aggregate
from quarrystone.operators import distinct
from quarrystone.operators.frequent import Counters, heavy_hitters
from quarrystone.operators.gaps import fill_gaps
from quarrystone.plans import ORACLE_SQL, QUERIES
from quarrystone.plans.counts import bucketed


def test_bitmaps_count_every_level(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3]), rng.choice([rng.randint(-100_000, 100_000), rng.randint(0, 9), None, 1 << 40])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, h int, u long").repartition(3)
    by = {"g": F.col("g"), "h": F.col("h")}
    state = distinct.bitmaps(df.limit(250), by, "u").union(distinct.bitmaps(df, by, "u"))  # parts that overlap
    sets = [["g", "h"], ["g"], ["h"], []]
    got = {(r.g, r.h, r.level): r.distinct for r in distinct.distinct_by_bitmaps(state, sets).collect()}
    want: dict = {}
    for g, h, u in rows:
        for i, s in enumerate(sets):
            if u is not None:
                want.setdefault((g if "g" in s else None, h if "h" in s else None, i), set()).add(u)
    assert got == {k: len(v) for k, v in want.items()}
    assert distinct.distinct_by_bitmaps(distinct.bitmaps(df.limit(0), by, "u"), sets).collect() == []


def test_sketches_merge_and_stay_near(spark):
    df = spark.range(60_000).selectExpr("id % 3 as g", "id as u")
    state = distinct.sketches(df, {"g": F.col("g")}, "u")
    total = state.agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", distinct.LOG_ENTRIES)).alias("n")).first().n
    assert abs(total - 60_000) < 4 * 0.011 * 60_000 and max(len(r.sketch) for r in state.collect()) <= 8 * 2**distinct.LOG_ENTRIES + 64
    small = distinct.sketches(df.where("u < 3000"), {"g": F.col("g")}, "u")
    assert [r.n for r in small.select(F.theta_sketch_estimate("sketch").alias("n")).collect()] == [1000] * 3
    assert distinct.sketches(df.limit(0), {"g": F.col("g")}, "u").collect() == []


def equals_sql(spark, oracle, path, name, table, df):
    """Whether the query on `df` alone, as that table, gives what its SQL does; the query's rows."""
    df.coalesce(1).write.parquet(str(path / f"{table}.parquet"))
    (path / "sql").mkdir()
    (path / f"sql/{table}.parquet").symlink_to(next((path / f"{table}.parquet").glob("part-*")))
    names, want, columns = oracle(ORACLE_SQL[name], str(path / "sql"))
    got = QUERIES[name](spark, str(path))
    assert sorted(got.columns) == names
    got = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_distinct_orders_of_large_flags(spark, oracle, tmp_path):
    """More orders of a flag than a sketch holds, and flags of unknown orders only."""
    many = spark.range(200_000).selectExpr("if(id % 2 = 0, 'A', null) as l_returnflag", "id as l_orderkey")
    rows = many.union(many.limit(1000)).union(spark.sql("SELECT * FROM VALUES ('N', CAST(null AS long)), ('N', null), ('A', null), ('R', 7), ('R', 7)"))
    got = equals_sql(spark, oracle, tmp_path, "approximate_distinct", "lineitem", rows)
    assert {r[0]: r[1] for r in got} == {"A": 100_000, None: 100_000, "N": 0, "R": 1}


def test_returning_users_of_large_days(spark, oracle, tmp_path):
    """More users than a sketch holds, on days that follow one another, lie within a week or apart, and unknown users and days."""
    day = "element_at(array(0, 1, 2, 6, 7, 8, 15, 400), 1 + cast(pmod(xxhash64(id), 8) as int))"
    many = spark.range(60_000).selectExpr("id as event_id", f"cast(timestampadd(MINUTE, cast(id % 1440 as int), date_add(DATE '2023-12-30', {day})) as timestamp_ntz) as ts", "id % 20000 as user_id")
    odd = spark.sql("SELECT 1L, TIMESTAMP_NTZ '2024-06-01 00:00:00', CAST(null AS long) UNION ALL SELECT 2L, null, 5L UNION ALL SELECT 3L, TIMESTAMP_NTZ '1969-12-31 23:59:59', -1L UNION ALL SELECT 4L, TIMESTAMP_NTZ '1970-01-01 00:00:00', -1L")
    got = equals_sql(spark, oracle, tmp_path, "returning_users", "events", many.union(odd))
    assert len(got) == 10 and max(r[3] for r in got) > 16_000 and max(r[2] for r in got) > 100


def test_a_sketch_is_held_against_the_orders(spark, oracle, tmp_path, monkeypatch):
    rows = spark.range(90_000).selectExpr("if(id % 3 = 0, 'A', 'N') as l_returnflag", "id as l_orderkey")
    got = equals_sql(spark, oracle, tmp_path, "approximate_distinct", "lineitem", rows)
    assert sorted(got) == [("A", 30_000, True), ("N", 60_000, True)]
    # An estimate that is off is told.
    monkeypatch.setattr(F, "theta_sketch_estimate", lambda _: F.lit(31_000))
    assert {r.l_returnflag: r.near for r in QUERIES["approximate_distinct"](spark, str(tmp_path)).collect()} == {"A": True, "N": False}


def test_counters_keep_their_bound():
    rng = random.Random(6)
    keys = [rng.choice("abc") if rng.random() < 0.3 else f"k{rng.randint(0, 4000)}" for _ in range(20_000)]
    counters = Counters(50)
    for i in range(0, len(keys), 700):
        counters.add(pa.array([*keys[i : i + 700], None]))
    exact = Counter(keys)
    assert len(counters.held) <= 50
    assert all(exact[k] - len(keys) / 51 <= counters.held.get(k, 0) <= exact[k] for k in exact)


@pytest.mark.parametrize("share", [0.3, 0.05, 0.01])
def test_heavy_hitters_are_exact(spark, share):
    rng = random.Random(1)
    keys = ["hot"] * 700 + [rng.choice(["a", "b", "c"]) for _ in range(300)] + [f"r{i}" for i in range(900)] + [None] * 100
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    want = {k: n for k, n in Counter(keys).items() if k is not None and n > share * len(keys)}
    assert dict(map(tuple, heavy_hitters(df, "key", share).collect())) == want
    assert heavy_hitters(df.limit(0), "key", share).collect() == []
    whole = spark.range(50).selectExpr("cast(null as string) as key")
    assert heavy_hitters(whole, "key", share).collect() == []


def test_gaps_are_filled(spark):
    rows = [("a", 3, 10), ("a", 7, 30), ("a", 8, None), ("a", None, 5), ("b", 0, 1), (None, 1, 4), (None, 3, 4), ("c", 2, None)]
    got = fill_gaps(spark.createDataFrame(rows, "k string, t int, v int"), ["k"], "t", "v").collect()
    want = [("a", 3, 10, 10, 10.0), ("a", 4, None, 10, 15.0), ("a", 5, None, 10, 20.0), ("a", 6, None, 10, 25.0), ("a", 7, 30, 30, 30.0), ("b", 0, 1, 1, 1.0), (None, 1, 4, 4, 4.0), (None, 2, None, 4, 4.0), (None, 3, 4, 4, 4.0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fill_gaps(spark.createDataFrame([], "k string, t int, v int"), ["k"], "t", "v").collect() == []


def test_variants_of_malformed_texts(spark):
    v = spark.sql("SELECT try_parse_json(x) AS v FROM VALUES ('{\"k\": 1}'), ('{\"k\": \"x\"}'), ('{'), (null), ('[]'), ('7') AS t(x)")
    assert [r.k for r in v.select(F.try_variant_get("v", "$.k", "int").alias("k")).collect()] == [1, None, None, None, None, None]


def test_bucketed_tables_join_without_an_exchange(spark):
    plan = QUERIES["bucketed_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a")], "k int, v string")
    assert sorted(map(tuple, bucketed(rows, "t", "k", 3).collect()), key=str) == sorted([(1, "a"), (None, "b"), (1, "a")], key=str)
    assert bucketed(rows.limit(0), "t", "k").collect() == []


def slow_distance(a, b):
    """The recurrence, letter by letter."""
    d = {(i, -1): len(a) + len(b) for i in range(-1, len(a) + 1)} | {(-1, j): len(a) + len(b) for j in range(-1, len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    seen: dict = {}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, low = seen.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, low - 1] + (i - k - 1) + 1 + (j - low - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


def test_edit_distance(spark):
    rng = random.Random(3)
    words = ["", "a", "ca", "abc", "é\U0001f600b", "abcd", "acbd"] + ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(12)]
    pairs = [*itertools.product(words, words), (None, "a"), ("a", None), (None, None)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", edit_distance("a", "b").alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [None if None in p else slow_distance(*p) for p in pairs]
    assert spark.createDataFrame([], "a string, b string").select(edit_distance("a", "b")).collect() == []


def test_products_of_odd_vectors(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), [rng.uniform(-1, 1) for _ in range(rng.choice([3, 3, 2, 0]))]) for _ in range(50)]
    odd = [("a", None), ("a", [None, 1.0]), ("b", [float("nan")]), ("c", [float("inf")])]
    df = spark.createDataFrame(rows + odd, "g string, v array<double>").repartition(4)
    want: dict = {}
    for g, v in rows:
        x = np.zeros(3, np.int64)
        x[: len(v)] = np.floor(np.array(v) * 1024)
        n, m = want.get(g, (0, np.zeros((3, 3), np.int64)))
        want[g] = n + 1, m + np.outer(x, x)
    for most in (64, 1):
        got = {r.g: (r.n, np.array(r.products).reshape(r.dims, r.dims).tolist()) for r in products_aggregate(df, "g", "v", most=most).collect()}
        assert got == {g: (n, m.tolist()) for g, (n, m) in want.items()}
    assert products_aggregate(df.limit(0), "g", "v").collect() == []


def test_balances_of_a_table_argument(spark):
    rows = [("a", 1, 5, 10), ("a", 2, 3, -4), ("a", 3, 3, 2), ("b", 4, 1, None), (None, 5, 1, 3), (None, 6, 2, -1), ("a", 7, 9, -50), ("a", 8, 10, 1)]
    df = spark.createDataFrame(rows, "key string, id int, at int, change long").repartition(3)
    got = Balance(df.asTable()).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 2, 0), ("a", 3, 2), ("a", 1, 12), ("a", 7, 0), ("a", 8, 1), ("b", 4, 0), (None, 5, 3), (None, 6, 2)], key=str)
    assert Balance(df.limit(0).asTable()).collect() == []
