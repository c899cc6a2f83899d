"""Frequent keys, exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.storage import Work


#: Keys that are counted at once.
BLOCK = 1 << 19


class Counters:
    """Misra-Gries counters: of n keys seen, each key's counter is below its count by n / (most + 1) at most, and keys without one have no more than that."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def add(self, keys: pa.Array) -> None:
        found = pc.value_counts(keys.drop_null())
        names, counts = found.field("values"), found.field("counts").to_numpy()
        if len(counts) > self.most:
            # Counters of the block itself, so that its rare keys never become objects.
            counts = counts - np.partition(counts, -self.most - 1)[-self.most - 1]
            on = np.flatnonzero(counts > 0)
            names, counts = names.take(pa.array(on)), counts[on]
        for k, c in zip(names.to_pylist(), counts.tolist(), strict=True):
            self.held[k] = self.held.get(k, 0) + c
        if len(self.held) > self.most:
            cut = sorted(self.held.values(), reverse=True)[self.most]
            self.held = {k: c - cut for k, c in self.held.items() if c > cut}


def heavy_hitters(df: DataFrame, key: str, share: float) -> DataFrame:
    """key, n: the keys that more than `share` of all rows have, with their exact counts; rows with a null key count among all.

    Each task keeps Misra-Gries counters of its rows. Their sums are short of the counts by less than half of the limit, so all keys in question have a sum above
    the other half, and no more than 2 / share keys can. Only those are counted in a second scan, before which they are sent to the tasks. Rare keys are neither grouped nor shuffled.
    An empty table has none.
    """
    if not 0 < share < 1:
        raise ValueError("a share lies between 0 and 1")
    work = Work(df.sparkSession, "frequent")
    rows = df.select(F.col(key).alias("key"))
    most = math.ceil(2 / share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, kind, held, total = Counters(most), None, [], 0

        def take():
            counters.add(pa.chunked_array(held).combine_chunks())
            held.clear()

        for batch in batches:
            kind, total = batch.column(0).type, total + batch.num_rows
            held.append(batch.column(0))
            if sum(map(len, held)) >= BLOCK:
                take()
        if held:
            take()
        if total:  # a null key carries the number of rows
            yield pa.RecordBatch.from_arrays([pa.array([None, *counters.held], kind), pa.array([total, *counters.held.values()], pa.int64())], ["key", "c"])

    sums = rows.mapInArrow(count, f"key {rows.schema['key'].dataType.simpleString()}, c long").groupBy("key").agg(F.sum("c").alias("c"))
    sums = work.put(sums, "sums")
    total = (sums.where("key is null").first() or {"c": 0})["c"]
    candidates = sums.where((F.col("c") > total * share / 2 - 1) & F.col("key").isNotNull()).select("key")
    found = rows.join(F.broadcast(candidates), "key").groupBy("key").agg(F.count("*").alias("n"))
    return found.where(F.col("n") > total * share).withColumnRenamed("key", key)
