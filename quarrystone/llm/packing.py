"""Packing of documents into sequences by hierarchical best fit.

Tasks pack what they read, block by block, by best-fit decreasing. Bins that are nearly full are done;
the others become items of the next round, where fewer tasks hold more of them. Rounds end when all
open bins fit one task, or when a round merges almost none, so no task ever holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarrystone.llm import text as T
from quarrystone.llm.tokens import Encoder
from quarrystone.llm.work import Work

_encoders: dict[str, Encoder] = {}


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each item, its offset there, fill of each bin) by best-fit decreasing.

    Open bins lie in stacks by what they have left; a bit set finds the smallest that suffices.
    """
    bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    fill: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0
    order = np.argsort(-length, kind="stable")
    at, off = [], []
    for n in length[order].tolist():
        fits = open_bits >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            stack = stacks[left]
            b = stack.pop()
            if not stack:
                open_bits &= ~(1 << left)
        else:
            b, left = len(fill), capacity
            fill.append(0)
        at.append(b)
        off.append(fill[b])
        fill[b] += n
        left -= n
        if left:
            stacks[left].append(b)
            open_bits |= 1 << left
    bins[order], offsets[order] = at, off
    return bins, offsets, fill


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers) of each document's pieces, in order."""

    def run(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in batches:
            for rows, data, offsets in T.chunks(batch):
                ids, first = encoder.encode(data, offsets)
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                first = first + np.arange(len(first))
                total = np.diff(first)
                pieces = -(-total // capacity)
                of = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of]
                short = (total - (pieces - 1) * capacity)[of]  # the first piece takes what the full ones leave
                start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
                length = np.where(piece == 0, short, capacity)
                at = np.append((first[of] + start) * 4, len(ids) * 4).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), blob],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.trimmed(run), "doc_id long, piece int, start long, length long, ids binary")


def _pack_blocks(column: str, out: str, offset: str, capacity: int, level: int, rows: int, size: int) -> Callable:
    """A mapInArrow function that packs each block of its rows by `column` and adds their bins, their offsets, and the bins' fills (on a bin's first item, else 0)."""

    def run(batches):
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []
        made = 0

        def flush():
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            bins, offsets, fill = best_fit(table.column(column).to_numpy().astype(np.int64), capacity)
            fills = np.where(offsets == 0, np.array(fill, np.int64)[bins], 0)
            table = table.append_column(out, pa.array(base + made + bins)).append_column(offset, pa.array(offsets)).append_column("bin_fill", pa.array(fills))
            made += len(fill)
            return table.to_batches()

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
                yield from flush()
        if sum(x.num_rows for x in held):
            yield from flush()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 1024,
    end_id: int = 2,
    derive: dict[str, Column] | None = None,
    keep_ids: bool = False,
    nearly_full: float = 1.0,
    block_rows: int = 50_000,
    block_bytes: int = 48 << 20,
) -> DataFrame:
    """A row per piece of each row of `docs` (doc_id, text): doc_id, piece, start, length, sequence_id, offset.

    A document's ids are those of `tokenizer` (a tokenizer file's path, by default the public byte-level BPE),
    without added special tokens, then `end_id`; a null text counts as empty. Only documents longer than `capacity`
    are cut: all pieces but the first are full. No sequence is longer than `capacity`, and offsets in one are
    gapless from 0. `derive` names columns computed from `ids` (binary, little-endian unsigned 32-bit numbers);
    `keep_ids` keeps the ids themselves. Bins filled to `nearly_full` are not opened again. Repeated rows give
    repeated pieces with places of their own; a null doc_id stays null; other columns of `docs` are ignored.
    """
    spark = docs.sparkSession
    work = Work(spark, "packing")
    pieces = token_pieces(docs, tokenizer or public_tokenizer(), capacity, end_id).withColumns(derive or {})
    pieces = work.put(pieces if keep_ids else pieces.drop("ids"), "pieces")
    grow = lambda df, *names: StructType([*df.schema.fields, *[StructField(x, LongType()) for x in names]])
    placed = work.put(pieces.mapInArrow(T.trimmed(_pack_blocks("length", "bin", "offset", capacity, 0, block_rows, block_bytes)), grow(pieces, "bin", "offset", "bin_fill")), "placed-0")
    work.drop("pieces")
    bins = work.put(placed.where(f"bin_fill > 0 and bin_fill < {nearly_full * capacity}").select("bin", F.col("bin_fill").alias("fill")), "open-0")
    moves, level = None, 0
    count = bins.count()
    while count > 1:
        level += 1
        parts = -(-count // block_rows)
        merged = bins.repartition(parts).mapInArrow(T.trimmed(_pack_blocks("fill", "parent", "shift", capacity, level, block_rows, block_bytes)), grow(bins, "parent", "shift", "bin_fill"))
        merged = work.put(merged, f"merged-{level}")
        step = merged.select("bin", "parent", "shift")
        if moves is None:
            moves = step
        else:
            up = step.select(F.col("bin").alias("mid"), F.col("parent").alias("top"), F.col("shift").alias("more"))
            moves = moves.join(up, moves.parent == up.mid, "left").select("bin", F.coalesce("top", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moves = work.put(moves, f"moves-{level}")
        bins = merged.where(f"bin_fill > 0 and bin_fill < {nearly_full * capacity}").select(F.col("parent").alias("bin"), F.col("bin_fill").alias("fill"))
        before, count = count, bins.count()
        if parts == 1 or count > 0.99 * before:
            break
    out = placed.drop("bin_fill")
    if moves is None:
        out = out.withColumnRenamed("bin", "sequence_id")
    else:
        out = out.join(moves, "bin", "left").withColumns({"sequence_id": F.coalesce("parent", "bin"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))})
    return out.select(*pieces.columns, "sequence_id", "offset")
