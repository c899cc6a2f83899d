from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.python import html_text
from quarrystone.operators.asof import asof_join
from quarrystone.operators.percentile import exact_percentile, exact_percentiles
from quarrystone.operators.sessions import sessionize
from quarrystone.operators.topk import top_per_group


def test_asof_join_ties_nulls_and_gaps(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 10), (4, None, 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 6, 1), ("a", 10, 2), ("a", 10, 3), ("a", 11, 9), ("b", 11, 4)], "k string, t int, v int")
    got = asof_join(left, right, ["k"], "t", ["v"]).collect()
    assert sorted((r.id, r.v_asof) for r in got) == [(1, 3), (2, None), (3, None), (4, None)]
    assert got[0].asDict().keys() == {"id", "k", "t", "v_asof"}


def test_asof_join_nulls_equal_nothing(spark):
    left = spark.createDataFrame([(1, None, 10), (2, "a", None), (3, "a", 10)], "id int, k string, t int")
    right = spark.createDataFrame([(None, 5, 77), ("a", None, 88), ("a", 10, 9)], "k string, t int, v int")
    assert sorted((r.id, r.v_asof) for r in asof_join(left, right, ["k"], "t", ["v"]).collect()) == [(1, None), (2, None), (3, 9)]


def test_exact_percentile(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=5000), "b": np.repeat([1.0, 2.0], 700), "c": np.array([7.0]), None: rng.integers(0, 9, 301).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for p in (0.0, 0.1, 0.5, 0.777, 1.0):
        for accuracy in (50, 10_000):
            got = {r.g: r.percentile for r in exact_percentile(df, "g", "x", p, accuracy).collect()}
            assert set(got) == set(groups)
            assert all(abs(got[g] - np.quantile(xs, p)) < 1e-9 for g, xs in groups.items()), (p, accuracy)
    assert exact_percentile(df.limit(0), "g", "x", 0.5).collect() == []


def test_several_percentiles_at_once(spark):
    rows = [("a", float(i), None) for i in range(11)] + [("a", None, 4.0), ("b", None, 1.0), ("b", None, 2.0), ("c", None, None)]
    got = exact_percentiles(spark.createDataFrame(rows, "g string, x double, y double"), "g", {"m": ("x", 0.5), "top": ("x", 1.0), "y": ("y", 0.5)})
    assert sorted(map(tuple, got.collect())) == [("a", 5.0, 10.0, 4.0), ("b", None, None, 1.5)]


def test_asof_join_of_a_hot_key_in_chunks(spark):
    import bisect
    import random

    rng = random.Random(4)
    left = [(i, "hot" if i % 2 else rng.choice(["a", "b", None]), rng.choice([rng.randint(-500, 500), None, 7])) for i in range(400)]
    right = [("hot" if i % 2 else rng.choice(["a", "c"]), rng.randint(-400, 400), i) for i in range(120)] + [("hot", 5, None), ("a", None, 1)]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    known = {k: sorted((t, -1 if v is None else v) for kk, t, v in right if kk == k and t is not None) for k in ("hot", "a", "b", "c")}

    def expected(k, t):
        if k is None or t is None:
            return None
        at = bisect.bisect_right(known[k], (t, 10**9))
        return None if not at or known[k][at - 1][1] == -1 else known[k][at - 1][1]

    for chunk in (10, 100_000):
        got = asof_join(a, b, ["k"], "t", ["v"], chunk=chunk)
        assert got.columns == ["id", "k", "t", "v_asof"]
        assert sorted(map(tuple, got.collect())) == sorted((i, k, t, expected(k, t)) for i, k, t in left)
    assert asof_join(a, b.limit(0), ["k"], "t", ["v"]).where("v_asof is not null").count() == 0 and asof_join(a.limit(0), b, ["k"], "t", ["v"]).count() == 0


def test_html_text(spark):
    html = "<title>A &amp; B</title><style>p{}</style><p>One <b>two</b><script>var x='<p>no</p>'</script><p>three<br>four<!-- no --><a href='/x'>link</a> &lt;5"
    got = html_text(spark.createDataFrame([(1, html, "z"), (2, None, "z"), (3, "", "z")], "page_id int, html string, title string")).orderBy("page_id").collect()
    assert (got[0].title, got[0].links, got[0].body) == ("A & B", 1, "One two\nthree\nfourlink <5")
    assert [(r.title, r.links, r.body) for r in got[1:]] == [("", 0, ""), ("", 0, "")]


def test_sessions(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 01:00:00'), (1, TIMESTAMP '2024-01-01 03:00:00'), (2, TIMESTAMP '2024-01-01 03:00:00') AS t(u, ts)")
    assert [r.session for r in sessionize(df, ["u"], "ts", "1 HOUR").orderBy("u", "ts").collect()] == [1, 1, 2, 1]


def test_rows_without_a_time_are_in_no_session(spark):
    df = spark.sql("SELECT * FROM VALUES (1, null), (1, null), (1, TIMESTAMP '2024-01-01 01:00:00'), (1, TIMESTAMP '2024-01-01 01:00:00'), (1, TIMESTAMP '2024-01-01 03:00:00'), (2, null) AS t(u, ts)")
    assert [r.session for r in sessionize(df, ["u"], "ts", "1 HOUR").orderBy("u", "ts").collect()] == [None, None, 1, 1, 2, None]
    assert sessionize(df.limit(0), ["u"], "ts", "1 HOUR").collect() == []


def test_top_per_group_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g int, x int")
    assert top_per_group(df, ["g"], [F.desc("x")], 2).collect() == []
