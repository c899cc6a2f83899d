"""How filters interact: what each removes, by every order in which they could be applied.

A document's failures are a bit set. What an order does with it is its first filter that fails, which a table of all
bit sets and all orders holds beforehand; tasks count documents by bit set and label, spread the counts by
that table, and their arrays are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm import text as T
from quarrystone.llm.columns import named
from quarrystone.llm.work import Work

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Bytes of text that are split into words at once.
PIECE = 1 << 20
#: Parts whose counts a task holds before it gives them on, and rows that it counts at once.
HELD_PARTS, ROWS = 256, 512

_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))


def first_failures() -> np.ndarray:
    """(bit sets, orders): the step (from 0) of the first filter of the order that the set holds; STEPS where it holds none."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for o, order in enumerate(ORDERS):
        for step, name in reversed(list(enumerate(order))):
            table[(np.arange(1 << STEPS) >> FILTERS.index(name)) & 1 == 1, o] = step
    return table


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes that do not part a word, so that words of a long text are not all held at once."""
    at = 0
    while len(text) - at > PIECE:
        found = [i for i in (text.find(b, at + PIECE) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if i >= 0]
        if not found:
            break
        yield text[at : min(found)]
        at = min(found)
    yield text[at:]


def own_failures(text: bytes) -> int:
    """The bits of A to D: those that the text alone decides."""
    count, distinct = 0, set()
    for piece in pieces(text):
        words = piece.split()  # bytes are split at 0x20 and 0x09 to 0x0D
        count += len(words)
        distinct.update(words)
    bare = len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return (count < 200) | (100 * len(distinct) < 50 * count) << 1 | (100 * (len(text) - bare) > 3 * points) << 2 | signs << 3


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and failures (bits of FILTERS, A lowest) of each row of `docs`.

    A null text counts as empty, a null part as the empty string. E holds rows whose text is that of a row with a smaller doc_id
    (texts are compared by SHA-256); a row without a doc_id is neither smaller than another nor larger, and rows that repeat the smallest
    doc_id do not fail it. Texts are read once, and only digests are shuffled.
    """
    work = Work(docs.sparkSession, "audit")
    rows = docs.select(
        F.col(f"`{named(docs, 'doc_id')}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{named(docs, part)}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{named(docs, 'text')}`").cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(2)]
            digests = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(list(map(own_failures, texts)), pa.int32())], ["doc_id", "part", "digest", "own"])

    judged = work.put(rows.mapInArrow(T.trimmed(run), "doc_id long, part string, digest binary, own int"), "judged")
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return judged.join(first, "digest", "left").select("doc_id", "part", (F.col("own") + F.when(late, 16).otherwise(0)).alias("failures"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step (from 1) and the counts of documents at it: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row for every part, order and step, zeros included; none of an empty table. Failures are those of `failures`. A document counts as good
    (toxic) if any row of `labels` with its doc_id has quality (toxic) 1; null labels and documents without a doc_id are neither. Rows that
    repeat are documents of their own.
    """
    flag = lambda name: F.max(F.coalesce((F.col(f"`{named(labels, name)}`") == 1).cast("int"), F.lit(0)))
    known = labels.groupBy(F.col(f"`{named(labels, 'doc_id')}`").cast("long").alias("of")).agg((flag("quality") + 2 * flag("toxic")).alias("label")).where("of is not null and label > 0")
    rows = failures(docs, part)
    rows = rows.join(known, rows.doc_id == known.of, "left").select("part", "failures", F.coalesce("label", F.lit(0)).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, orders = first_failures(), np.arange(len(ORDERS))
        cells = len(ORDERS) * (STEPS + 1)
        held: dict[str, np.ndarray] = {}

        def give():
            if held:
                counts = np.stack(list(held.values()))  # (parts, labels, orders * steps)
                removed, good, toxic = counts.sum(axis=1), counts[:, 1] + counts[:, 3], counts[:, 2] + counts[:, 3]
                names = pa.array(list(held)).take(pa.array(np.repeat(np.arange(len(held)), cells)))
                cell = np.tile(np.arange(cells), len(held))
                held.clear()
                yield pa.RecordBatch.from_arrays([names, *[pa.array(x.astype(t)) for x, t in ((cell // (STEPS + 1), np.int32), (cell % (STEPS + 1), np.int32), (removed.ravel(), np.int64), (good.ravel(), np.int64), (toxic.ravel(), np.int64))]], ["part", "order", "step", "removed", "good", "toxic"])

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            names = batch.column(0).dictionary_encode()
            of = names.indices.to_numpy()
            code = (of.astype(np.int64) * 4 + batch.column(2).to_numpy()) * len(table) + batch.column(1).to_numpy()
            seen, times = np.unique(code, return_counts=True)
            # Each bit set that was seen, at its first failure in each order.
            at = (seen // len(table))[:, None] * cells + orders * (STEPS + 1) + table[seen % len(table)]
            found = np.bincount(at.ravel(), np.repeat(times, len(ORDERS)), len(names.dictionary) * 4 * cells).astype(np.int64).reshape(-1, 4, cells)
            for name, counts in zip(names.dictionary.to_pylist(), found, strict=True):
                held[name] = held[name] + counts if name in held else counts
                if len(held) >= HELD_PARTS:
                    yield from give()
        yield from give()

    partial = rows.mapInArrow(T.trimmed(run), "part string, `order` int, step int, removed long, good long, toxic long")
    cell = partial.groupBy("part", "order", "step").agg(*[F.sum(x).alias(x) for x in ("removed", "good", "toxic")])
    # From here on, a part has 720 rows.
    cell = cell.withColumn("filter_order", F.element_at(F.array(*map(F.lit, ORDERS)), F.col("order") + 1)).withColumn("filter", F.substr("filter_order", F.col("step") + 1, F.lit(1)))
    in_order, of_filter = Window.partitionBy("part", "order"), Window.partitionBy("part", "filter")
    after = in_order.orderBy("step").rowsBetween(Window.currentRow + 1, Window.unboundedFollowing)
    at_step = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(of_filter)
    return (
        cell.withColumn("kept", F.sum("removed").over(after))
        .withColumns({"fails": at_step(0), "unique_fails": at_step(STEPS - 1), "shapley": F.sum("removed").over(of_filter)})
        .where(F.col("step") < STEPS)
        .select("part", "filter_order", (F.col("step") + 1).alias("step"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
    )
