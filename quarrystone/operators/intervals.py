"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.storage import Work

#: Bits of the narrowest bin (of microseconds: about a second), bits between levels, and the widest level that 63 bits allow.
GRAIN, STEP, TOP = 20, 2, 21


def _bin(at: Column, level: Column) -> Column:
    """The number of the level's bin that holds `at`; rounded down, for times before the epoch, too."""
    return F.call_function("shiftright", at, (level * STEP + GRAIN).cast("int"))


def _tagged(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """row, k0.., s, e, level: rows that can match, with the level of whose bins each covers two at most."""
    rows = df.select(F.struct("*").alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    rows = rows.where(" and ".join(["s <= e", *[f"k{i} is not null" for i in range(len(by))]]))
    level = F.ceil((F.log2((F.col("e").cast("double") - F.col("s")) + 1) - GRAIN) / STEP)
    return rows.withColumn("level", F.least(F.lit(TOP), F.greatest(F.lit(0), level)).cast("int"))


def _spread(rows: DataFrame, partners: list[int]) -> DataFrame:
    """A row for each bin, on the levels where a partner can meet it: its own, if shorter ones exist, and those of longer ones."""
    longer = F.filter(F.array(*map(F.lit, partners)), lambda k: k > F.col("level"))
    levels = F.concat(F.when(F.col("level") >= min(partners), F.array("level")).otherwise(F.array().cast("array<int>")), longer)
    rows = rows.withColumn("k", F.explode(levels))
    return rows.withColumn("bin", F.explode(F.sequence(_bin(F.col("s"), F.col("k")), _bin(F.col("e"), F.col("k")))))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], hot_rows: int = 50_000, suffix: str = "_right") -> DataFrame:
    """Pairs of rows equal in `by` whose closed intervals have a point in common; columns of `right` that `left` has, too, get `suffix`.

    Spans are (start, end) columns of whole numbers (see `functions.micros` for times). Intervals are dealt to bins of a width that suits their
    length, on levels four times as wide each, so an interval lies in two bins a level whatever its length, and meets longer partners on
    their level. A pair is made in the bin of the later start only. A bin with more than `hot_rows` rows of a side is cut into a grid of
    chunks of both sides, by a hash of the rows, so no task holds it whole; rows that are equal in all columns stay together. Plans are equi-joins for any
    `by`, the empty one included.

    Null bounds, null keys, and ends before their starts match nothing; an interval of one point is one; repeated rows pair once each; empty
    tables give no pairs.
    """
    a, b = _tagged(left, by, *left_span), _tagged(right, by, *right_span)
    # At most TOP + 1 numbers a side.
    levels = [sorted(x.agg(F.collect_set("level").alias("l")).first()["l"]) for x in (a, b)]
    names = [*[F.col(f"l.row.`{c}`").alias(c) for c in left.columns], *[F.col(f"r.row.`{c}`").alias(c + suffix if c.lower() in {x.lower() for x in left.columns} else c) for c in right.columns]]
    a, b = _spread(a, levels[1] or [TOP]), _spread(b, levels[0] or [TOP])
    keys = [*[f"k{i}" for i in range(len(by))], "k", "bin"]
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    chunks = lambda c: F.ceil(F.col(c) / hot_rows).cast("int")
    hot = count(a, "na").join(count(b, "nb"), keys).where(f"na > {hot_rows} or nb > {hot_rows}").select(*keys, chunks("na").alias("na"), chunks("nb").alias("nb"))

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one chunk of its side, and once for each chunk of the other."""
        df = df.join(hot, keys, "left").withColumns({"na": F.coalesce("na", F.lit(1)), "nb": F.coalesce("nb", F.lit(1))})
        mine = F.pmod(F.xxhash64("row"), F.col(own)).cast("int")
        return df.select("row", "s", "e", "level", *keys, mine.alias(f"c{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"c{other}"))

    pairs = cut(a, "na", "nb").alias("l").join(cut(b, "nb", "na").alias("r"), [F.col(f"l.{x}") == F.col(f"r.{x}") for x in [*keys, "cna", "cnb"]])
    meet = (F.col("l.s") <= F.col("r.e")) & (F.col("r.s") <= F.col("l.e"))
    once = (F.col("l.k") == F.greatest("l.level", "r.level")) & (F.col("l.bin") == _bin(F.greatest("l.s", "r.s"), F.col("l.k")))
    return pairs.where(meet & once).select(*names)


def overlap_sums(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], weights: dict[str, Column]) -> DataFrame:
    """`left` with the columns of `weights`: sums of whole numbers over the rows of `right` whose closed intervals have a point in common with the row's, 0 where there are none.

    No pair is made, and work grows with the rows of both sides, whatever overlaps: what meets a span is what starts by its end, less what ends before its start. Both
    are running sums over the distinct bounds of both sides; these are dealt to ranges of them, and what earlier ranges leave is a row a range, so no task holds them all.

    Spans are as for `overlap_join`: null bounds and ends before their starts match nothing; repeated rows count once each.
    """
    work = Work(left.sparkSession, "overlap-sums")
    (ls, le), (rs, re) = [[F.col(c).cast("long") for c in span] for span in (left_span, right_span)]
    own, n = [F.coalesce(w.cast("long"), F.lit(0)) for w in weights.values()], range(len(weights))
    opened, closed = [f"__o{i}" for i in n], [f"__c{i}" for i in n]
    mark = lambda at, o, c: F.struct(at.alias("__at"), *[x.alias(k) for x, k in zip([*o, *c], [*opened, *closed], strict=True)])
    none = [F.lit(0).cast("long") for _ in n]
    marks = right.where(rs <= re).select(F.explode(F.array(mark(rs, own, none), mark(re, none, own))).alias("m"))
    asked = left.where(ls <= le).select(F.explode(F.array(mark(ls, none, none), mark(le, none, none))).alias("m"))
    marks = marks.union(asked).select("m.*").groupBy("__at").agg(*[F.sum(c).alias(c) for c in [*opened, *closed]])
    # A table: the numbers of the ranges must stay as they are.
    marks = work.put(marks.repartitionByRange("__at").withColumn("__part", F.spark_partition_id()), "marks")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.groupBy("__part").agg(*[F.sum(c).alias(c) for c in [*opened, *closed]])
    before = before.select("__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}b") for c in [*opened, *closed]])
    upto = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    sums = marks.withColumns({f"{c}s": F.sum(c).over(upto) for c in [*opened, *closed]}).join(before, "__part")
    sums = sums.select("__at", *[(F.col(f"{c}s") + F.col(f"{c}b")).alias(c) for c in opened], *[(F.col(f"{c}s") - F.col(c) + F.col(f"{c}b")).alias(c) for c in closed])
    sums = work.put(sums, "sums")
    rows = left.withColumns({"__ls": F.when(ls <= le, ls), "__le": F.when(ls <= le, le)})
    rows = rows.join(sums.select(F.col("__at").alias("__le"), *opened), "__le", "left").join(sums.select(F.col("__at").alias("__ls"), *closed), "__ls", "left")
    return rows.select(*left.columns, *[F.coalesce(F.col(o) - F.col(c), F.lit(0)).alias(name) for name, o, c in zip(weights, opened, closed, strict=True)])
