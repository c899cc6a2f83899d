"""Compression of vectors into codes of their parts.

Vectors become integers and are written as columnar blocks: for each part and each place in it, that component of all
vectors of the block. A round broadcasts the codebooks, which have a fixed size, and reduces the blocks with a
tree of int64 sums and counts; nothing that grows with the table reaches the driver or one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarrystone.llm import text as T
from quarrystone.llm.columns import named
from quarrystone.llm.work import Work

#: Vectors of a block, and of a step within one: distances of a step to all entries fit a core's cache.
BLOCK, STEP = 4096, 512


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null where the vector or a component is null or not finite."""
    x = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale)))


def check_range(rows: DataFrame, values: str, dims: int) -> None:
    """ValueError where a squared distance, or a sum over the table, could leave 64 bits."""
    bound = int((2**62 / max(dims, 1)) ** 0.5 / 2)
    wide = rows.where(F.exists(values, lambda v: (v > bound) | (v < -bound))).limit(1).count()
    if wide:
        raise ValueError(f"a component times the scale is beyond {bound}: its squared distances do not fit 64 bits")


def columnar(vectors: list, parts: int, size: int) -> np.ndarray:
    """(parts, size, vectors): components by part and place; shorter vectors go on with zeros."""
    x = np.zeros((len(vectors), parts * size), np.int64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return np.ascontiguousarray(x.reshape(len(vectors), parts, size).transpose(1, 2, 0))


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each vector of one part's block (size, vectors), ties to the lower index; entries are (count, size)."""
    size, n = block.shape
    reach = max(int(np.abs(block).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # Narrow numbers are several times as fast.
    kind = np.int32 if size * (2 * reach) ** 2 < 2**31 else np.int64
    block, entries = block.astype(kind), entries.astype(kind)
    index, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(0, n, STEP):
        part = block[:, a : a + STEP]
        distance = np.zeros((part.shape[1], len(entries)), kind)
        for d in range(size):
            gap = part[d][:, None] - entries[:, d][None, :]
            gap *= gap
            distance += gap
        index[a : a + STEP] = distance.argmin(axis=1)
        error[a : a + STEP] = distance[np.arange(part.shape[1]), index[a : a + STEP]]
    return index, error


class Codebooks:
    """The entries of all parts, (parts, entries, size) integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def refined(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry replaced by the floors of the means of what was nearest to it; entries without any stay."""
        new = self.entries.copy()
        used = counts > 0
        new[used] = sums[used] // counts[used][:, None]
        return Codebooks(new)


def compress_vectors(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, depth: int = 2
) -> tuple[DataFrame, Codebooks]:
    """(a row per kept vector, the codebooks): vec_id, label, code (two hex digits a part), error (squared distance to what the code stands for).

    Components become floor(scale * x). Rows whose vector is null, or holds null, NaN or infinite components, are dropped; repeated
    rows are vectors of their own. Vectors are cut into `parts` equal parts; all are as long as the longest one, rounded up to a
    multiple of `parts`, with zeros at the end of shorter ones. A part's codebook starts with that part of the `entries` vectors of the
    smallest ids (nulls last, ties by the vector) and is refined `rounds` times with the floors of means; with fewer vectors it has
    fewer entries. An empty table has no rows and empty codebooks. Components whose squared distances could leave 64 bits
    raise ValueError. Other columns are ignored; `entries` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: entries must be from 1 to 256")
    spark = df.sparkSession
    work = Work(spark, "codes")
    rows = df.select(F.col(f"`{named(df, id)}`").alias("vec_id"), F.col(f"`{named(df, label)}`").alias("label"), integers(named(df, vector), scale).alias("values")).where("values is not null")
    longest = rows.agg(F.max(F.size("values"))).first()[0] or 0
    size = -(-longest // parts)
    check_range(rows, "values", parts * size)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "values").limit(entries).select("values").collect()
    books = Codebooks(columnar([r["values"] for r in first], parts, size).transpose(0, 2, 1).copy())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, min(BLOCK, batch.num_rows - at))
                x = columnar([v.values.to_numpy() for v in part.column(2)], parts, size)
                one = lambda i, part=part: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i))
                yield pa.RecordBatch.from_arrays([one(0), one(1), pa.array([x.tobytes()], pa.binary())], ["ids", "labels", "values"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    blocks = work.put(rows.mapInArrow(T.trimmed(pack), f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, `values` binary"), "blocks")

    def add(held, row):
        """Adds a block's sums and counts by nearest entry to what a task holds."""
        own, (sums, counts) = now.value, held or (np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))
        x = np.frombuffer(row[0], np.int64).reshape(parts, size, -1)
        for p in range(parts):
            index, _ = nearest(x[p], own[p])
            np.add.at(counts[p], index, 1)
            for d in range(size):
                np.add.at(sums[p, :, d], index, x[p, d])
        return sums, counts

    def merge(a, b):
        return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

    shape = books.entries.shape
    for _ in range(rounds if size else 0):
        now = spark.sparkContext.broadcast(books.entries)
        found = blocks.select("values").rdd.treeAggregate(None, add, merge, depth)
        now.unpersist()
        books = books.refined(*found) if found else books

    last = books.entries

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, values in zip(*batch.columns, strict=True):
                x = np.frombuffer(values.as_buffer(), np.int64).reshape(parts, size, -1) if size else np.zeros((parts, 0, len(ids.values)), np.int64)
                found = [nearest(x[p], last[p]) for p in range(parts)]
                digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes, pa.string()), pa.array(sum(e for _, e in found), pa.int64())], ["vec_id", "label", "code", "error"])

    out = StructType([*rows.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    return blocks.mapInArrow(T.trimmed(code), out), books
