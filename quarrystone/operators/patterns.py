"""Sequences of rows that match a pattern."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from quarrystone.functions import at_micros, micros
from quarrystone.storage import Work

HOUR = 3_600_000_000


class Steps:
    """A pattern as an automaton. Rows are of a step's kind (from 1) or of none (0); in state n, a row of step n has come last."""

    def __init__(self, repeats: list[bool]):
        if len(repeats) < 2 or repeats[0] or repeats[-1]:
            raise ValueError("a pattern needs two steps, and its first and last step are single rows")
        self.repeats, self.last = repeats, len(repeats)

    def next(self, state: int, kind: int) -> int:
        if kind == 1:
            return 1
        if state and (kind == state + 1 or (kind == state and self.repeats[state - 1])):
            return kind
        return 0


class Chunk:
    """What a run of a key's rows, in order, does with whatever state came before it."""

    def __init__(self, steps: Steps):
        self.steps, self.rows = steps, 0
        #: Of each state that may have come before: the one it has become, until it is lost; and the row that completed it.
        self.alive = {i: i for i in range(1, steps.last)}
        self.done: dict[int, tuple[int, int, int]] = {}
        #: State, first row, its time, and rows of a match begun here.
        self.own: tuple[int, int, int, int] | None = None

    def add(self, kind: int, id: int, at: int) -> tuple | None:
        """Takes a row; gives the match (first id, last id, start, end, rows) that began in this chunk and ends with it."""
        steps = self.steps
        if self.alive:
            self.rows += 1
            moved = {i: steps.next(s, kind) for i, s in self.alive.items()} if kind != 1 else {}
            self.done |= {i: (id, at, self.rows) for i, s in moved.items() if s == steps.last}
            self.alive = {i: s for i, s in moved.items() if 0 < s < steps.last}
        if kind == 1:
            self.own = (1, id, at, 1)
        elif self.own:
            state, first, start, rows = self.own
            state = steps.next(state, kind)
            self.own = (state, first, start, rows + 1) if 0 < state < steps.last else None
            if state == steps.last:
                return first, id, start, at, rows + 1
        return None

    def edge(self) -> dict:
        own = dict(zip(("state", "first_id", "started", "rows"), self.own, strict=True)) if self.own else None
        alive = [{"before": i, "after": s} for i, s in self.alive.items()]
        return {"rows": self.rows, "own": own, "alive": alive, "done": [{"before": i, "last_id": x[0], "ended": x[1], "rows": x[2]} for i, x in self.done.items()]}


_MATCH = "first_id long, last_id long, started long, ended long, n_rows long"
_EDGE = "edge struct<rows: long, own: struct<state: int, first_id: long, started: long, rows: long>, alive: array<struct<before: int, after: int>>, done: array<struct<before: int, last_id: long, ended: long, rows: long>>>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def match_rows(df: DataFrame, by: list[str], on: str, id: str, steps: list[tuple[Column, bool]], within: int | None = None, others_break: bool = True, chunk: int = 7 * 24 * HOUR) -> DataFrame:
    """by, first_id, last_id, started, ended, n_rows: each run of a key's rows, in order of `on`, that is one row of each of `steps` in turn.

    A step is (condition, repeats): one row that meets it or, if it repeats, one and more. The first and the last step are single rows. A row is of the first
    step whose condition it meets. Rows of no step break a match, or count for nothing if not `others_break`. Matches begin at the last row of the first step,
    and share no row. Those longer than `within` microseconds are left out.

    A key's rows are cut into chunks of `chunk` microseconds, each run through the automaton by itself, for every state that it may be entered in; what crosses
    chunks is put together from a row a chunk, so no task holds a key of many rows.

    Rows without a time or id are left out; null keys are a key. Of rows of one time the smaller id, then the earlier step, comes first; repeated rows
    count each. An empty table has no matches. `id` is a whole number.
    """
    work = Work(df.sparkSession, "patterns")
    automaton = Steps([repeats for _, repeats in steps])
    kind = F.lit(0)
    for i, (condition, _) in reversed(list(enumerate(steps, 1))):
        kind = F.when(condition, i).otherwise(kind)
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], micros(df, on).alias("at"), F.col(id).cast("long").alias("id"), kind.alias("kind")).where("at is not null and id is not null")
    rows = rows if others_break else rows.where("kind > 0")
    keys = [f"k{i}" for i in range(len(by))]
    rows = rows.withColumn("chunk", F.floor(F.col("at") / chunk))
    rows = rows.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", "at", "id", "kind").select(*keys, "chunk", "at", "id", "kind")
    of_key, of_match = rows.schema.fields[: len(by)], StructType.fromDDL(_MATCH).fields
    with_edges = StructType([*of_key, StructField("chunk", LongType()), *of_match, *StructType.fromDDL(_EDGE).fields])
    matches = StructType([*of_key, *of_match])
    parts, crossing = to_arrow_schema(with_edges), to_arrow_schema(matches)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now, nothing = None, None, (None,) * 5
        for batch in batches:
            out = []
            for *group, at, row, kind in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or group != of:
                    if now is not None:
                        out.append((*of, *nothing, now.edge()))
                    of, now = group, Chunk(automaton)
                match = now.add(kind, row, at)
                if match:
                    out.append((*of, *match, None))
            if out:
                yield _batch(out, parts)
        if now is not None:
            yield _batch([(*of, *nothing, now.edge())], parts)

    parsed = work.put(rows.mapInArrow(parse, with_edges), "parsed")
    edges = parsed.where("edge is not null").select(*keys, "chunk", "edge").repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "edge")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, begun = None, None
        for batch in batches:
            out = []
            for *key, edge in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != of:
                    of, begun = key, None
                if begun:
                    for x in edge["done"]:
                        if x["before"] == begun["state"]:
                            out.append((*key, begun["first_id"], x["last_id"], begun["started"], x["ended"], begun["rows"] + x["rows"]))
                    after = [x["after"] for x in edge["alive"] if x["before"] == begun["state"]]
                    begun = begun | {"state": after[0], "rows": begun["rows"] + edge["rows"]} if after else None
                begun = edge["own"] or begun
            if out:
                yield _batch(out, crossing)

    found = parsed.where("edge is null").drop("chunk", "edge").unionByName(edges.mapInArrow(join, matches))
    if within is not None:
        found = found.where(F.col("ended") - F.col("started") <= within)
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "first_id", "last_id", at_micros("started").alias("started"), at_micros("ended").alias("ended"), "n_rows")

