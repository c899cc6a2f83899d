"""Queries over intervals, sequences and reach, and over streams joined or timed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone import streaming
from quarrystone.functions import at_micros, micros, utc
from quarrystone.operators.intervals import overlap_join, overlap_sums
from quarrystone.operators.patterns import HOUR, match_rows
from quarrystone.operators.reach import hops
from quarrystone.operators.sessions import sessionize
from quarrystone.plans.registry import query, streamed
from quarrystone.storage import Work
from quarrystone.streaming.joins import interval_join
from quarrystone.streaming.timers import sessions


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS opened, max(l_shipdate) AS closed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING max(l_shipdate) >= o_orderdate)
          SELECT a.o_custkey, a.o_orderkey AS first_order, b.o_orderkey AS second_order, greatest(a.opened, b.opened) AS since, least(a.closed, b.closed) AS until
          FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.opened <= b.closed AND b.opened <= a.closed""")
def overlapping_orders(spark, t):
    """Pairs of a customer's orders that were open, from order to last shipment, at the same time; those whose last shipment is before the order were never open."""
    shipped = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    o = t("orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("opened"), "closed")
    # A table: the join looks at both sides several times.
    o = Work(spark, "overlapping-orders").put(o.withColumns({"s": micros(o, "opened"), "e": micros(o, "closed")}), "orders")
    pairs = overlap_join(o, o, ["o_custkey"], ("s", "e"), ("s", "e"), suffix="_b").where("o_orderkey < o_orderkey_b")
    return pairs.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderkey_b").alias("second_order"), F.greatest("opened", "opened_b").alias("since"), F.least("closed", "closed_b").alias("until"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          s AS (SELECT user_id, session, min(ts) AS s, max(ts) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g) GROUP BY 1, 2)
          SELECT event_id, count(s.s) AS sessions, count(DISTINCT s.user_id) AS users FROM (SELECT * FROM events WHERE event_type = 'signup') x
          LEFT JOIN s ON s.s <= x.ts + INTERVAL 1 HOUR AND s.e >= x.ts GROUP BY event_id""")
def sessions_around_signups(spark, t):
    """For each signup, all users' sessions (runs of events at most six hours apart) that overlap the hour after it."""
    e = t("events")
    e = e.withColumn("at", micros(e, "ts"))
    runs = sessionize(e.where("ts is not null").select("user_id", "ts", "at"), ["user_id"], "ts", "6 HOURS").groupBy("user_id", "session").agg(F.min("at").alias("s"), F.max("at").alias("e"))
    runs = Work(spark, "sessions").put(runs, "runs")
    signups = e.where("event_type = 'signup'").select("event_id", "ts", F.col("at").alias("s"), (F.col("at") + HOUR).alias("e"))
    # What the hours after the signups of an event_id cover: mostly one signup's hour.
    spans = sessionize(signups.where("ts is not null"), ["event_id"], "ts", "1 HOURS").groupBy("event_id", "session").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = spans.withColumn("alone", (F.count("*").over(Window.partitionBy("event_id")) == 1) & (F.col("e") - F.col("s") <= 6 * HOUR))
    spans = Work(spark, "signups").put(spans, "spans")
    # A user's sessions are more than six hours apart, so no more than one meets a shorter span: users are counted as sessions are, without pairs.
    asked = signups.select("event_id", "s", "e", F.lit("sessions").alias("of")).union(spans.where("alone").select("event_id", "s", "e", F.lit("users")))
    known = F.col("user_id").isNotNull()
    sums = overlap_sums(asked, runs, ("s", "e"), ("s", "e"), {"sessions": F.lit(1), "users": known})
    sums = sums.select("event_id", *[F.when(F.col("of") == c, F.col(c)).otherwise(0).alias(c) for c in ("sessions", "users")])
    pairs = overlap_join(spans.where("not alone").select("event_id", "s", "e"), runs.where(known), [], ("s", "e"), ("s", "e"))
    users = pairs.select("event_id", "user_id").distinct().groupBy("event_id").agg(F.lit(0).cast("long").alias("sessions"), F.count("*").alias("users"))
    return sums.union(users).groupBy("event_id").agg(F.sum("sessions").alias("sessions"), F.sum("users").alias("users"))


@query("""WITH RECURSIVE e AS (
              SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
              FROM events WHERE event_type IN ('view', 'click', 'purchase') AND ts IS NOT NULL AND event_id IS NOT NULL
          ), m(user_id, n, state, first_id, started, last_id, ended, n_rows) AS (
              SELECT user_id, n, CASE WHEN kind = 1 THEN 1 ELSE 0 END, event_id, ts, event_id, ts, 1::BIGINT FROM e WHERE n = 1
              UNION ALL
              SELECT e.user_id, e.n, CASE WHEN kind = 1 THEN 1 WHEN state IN (1, 2) AND kind = 2 THEN 2 WHEN state = 2 AND kind = 3 THEN 3 ELSE 0 END,
                     CASE WHEN kind = 1 THEN e.event_id ELSE first_id END, CASE WHEN kind = 1 THEN ts ELSE started END, e.event_id, ts, CASE WHEN kind = 1 THEN 1 ELSE n_rows + 1 END
              FROM m JOIN e ON e.user_id IS NOT DISTINCT FROM m.user_id AND e.n = m.n + 1
          ) SELECT user_id, first_id, last_id, started, ended, n_rows FROM m WHERE state = 3 AND ended - started <= INTERVAL 72 HOUR""")
def view_click_purchase(spark, t):
    """Each user's sequences of a view, clicks and a purchase within 72 hours, other events aside."""
    steps = [(F.col("event_type") == "view", False), (F.col("event_type") == "click", True), (F.col("event_type") == "purchase", False)]
    return match_rows(t("events"), ["user_id"], "ts", "event_id", steps, within=72 * HOUR, others_break=False)


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, l_shipdate AS d FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND l_shipdate IS NOT NULL),
          e AS (SELECT DISTINCT a.s AS a, b.s AS b FROM m a JOIN m b ON a.p = b.p AND a.d = b.d AND a.s <> b.s),
          r(s, h) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier) UNION SELECT e.b, r.h + 1 FROM r JOIN e ON e.a = r.s WHERE r.h < 30)
          SELECT s AS s_suppkey, min(h)::INT AS hops FROM r GROUP BY s""")
def supplier_hops(spark, t):
    """How many steps suppliers are from those of the first nation, where a step is to ship the same part on the same day."""
    nation = t("supplier").agg(F.min("s_nationkey").alias("first"))
    sources = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("first")).select(F.col("s_suppkey").alias("node"))
    shipped = F.when(F.col("l_partkey").isNotNull() & F.col("l_shipdate").isNotNull(), F.struct("l_partkey", "l_shipdate"))
    return hops(t("lineitem").select(F.col("l_suppkey").alias("node"), shipped.alias("group")), sources).select(F.col("node").alias("s_suppkey"), "hops")


@streamed("""SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
             LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 HOUR WHERE p.ts IS NOT NULL""")
def streamed_views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of purchases joined with a stream of the views of the hour before; purchases without any are given once none can come."""
    sides, closes = [], []
    for kind in ("purchase", "view"):
        stream, close = streaming.with_closing(streaming.event_stream(spark, sf_dir), user_id=0)
        sides.append(stream.where(streaming.or_closing(f"event_type = '{kind}'")).select(F.col("event_id").alias(f"{kind}_id"), "user_id", "ts"))
        closes.append(close)
    found = interval_join(*sides, ["user_id"], "ts", "1 HOUR")
    out = streaming.drain(found, "append", lambda: [close() for close in closes])
    return out.where("purchase_id is not null").select("purchase_id", "view_id")


@streamed("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def streamed_timed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a custom processor, closed by event-time timers."""
    stream, close = streaming.with_closing(streaming.event_stream(streaming.stateful_session(spark), sf_dir))
    out = streaming.drain(sessions(stream), "append", close, spark)
    return out.select("user_id", at_micros("first").alias("started"), at_micros("last").alias("ended"), "n")
