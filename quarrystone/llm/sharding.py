"""Shards of near-equal bytes by histogram sort, in DataFrame operations only.

A document's key is the hash of its text, then that of its doc_id, then that of the whole row: equal texts are neighbours, and a
group of copies that is larger than a shard can still be cut. A group of rows equal in all columns is cut by
number. Each round counts the exact bytes below
candidate boundaries (the next PROBE_BITS bits of the key) inside the intervals where a splitter still
lies, until each splitter is within tolerance or has no key left to move over. The documents are
then exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.work import Work

PROBE_BITS = 6
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def _splitter(sizes: DataFrame, keys: list[str], targets: list[float], tolerance: float) -> list[tuple[int, ...]]:
    """For each target the key at which the bytes below come nearest to it, or within `tolerance`.

    keys: long columns, the most significant first. A splitter is a tuple of keys and a number; rows below it are left of it, and of those
    that are equal to it in all keys (and so in size), as many as the number says.
    """
    done: dict[int, tuple[int, ...]] = {}
    # Where splitter j still lies: the keys that are fixed, the bits and prefix of the next one, the bytes below.
    state = {j: ((), 0, 0, 0) for j in range(len(targets))}
    while state:
        regions = sorted({x[:3] for x in state.values()})
        # Regions of one round have no keys in common: a row is in one at most.
        pick = F.coalesce(*[F.when(_within(keys, *r), F.struct(F.lit(i).alias("region"), *_probe(keys[len(r[0])], r[1]))) for i, r in enumerate(regions)])
        found = sizes.select(pick.alias("p"), "size").where("p is not null").select("p.region", "p.probe", "p.key", "size")
        rows = found.groupBy("region", "probe").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        by: dict[tuple, list] = {r: [] for r in regions}
        for row in sorted(rows, key=lambda x: (x.region, x.probe)):
            by[regions[row.region]].append(row)
        for j, (fixed, bits, prefix, below) in list(state.items()):
            target, at = targets[j], below
            for row in by[fixed, bits, prefix]:
                if at + row.bytes > target:
                    break
                at += row.bytes
            else:  # rounding: the target is the region's end
                done[j] = (*fixed, *[_HIGHEST] * (len(keys) - len(fixed)), _HIGHEST)
                continue
            rest = len(keys) - len(fixed) - 1
            start = (*fixed, row.low, *[_LOWEST] * rest, 0)
            end = (*fixed, row.high, *[_HIGHEST] * rest, _HIGHEST)
            if target - at <= tolerance:
                done[j] = start
            elif at + row.bytes - target <= tolerance:
                done[j] = end
            elif row.low == row.high and not rest:
                done[j] = (*fixed, row.low, round((target - at) * row.rows / row.bytes))
            elif row.low == row.high:
                state[j] = ((*fixed, row.low), 0, 0, at)
                continue
            else:
                state[j] = (fixed, min(64, bits + PROBE_BITS), row.probe, at)
                continue
        state = {j: x for j, x in state.items() if j not in done}
    return [done[j] for j in range(len(targets))]


def _within(keys: list[str], fixed: tuple[int, ...], bits: int, prefix: int) -> Column:
    test = F.lit(True)
    for name, value in zip(keys, fixed, strict=False):
        test &= F.col(name) == value
    return test & (F.shiftright(F.col(keys[len(fixed)]), 64 - bits) == prefix) if bits else test


def _probe(key: str, bits: int) -> tuple[Column, Column]:
    to = min(64, bits + PROBE_BITS)
    return (F.shiftright(F.col(key), 64 - to) if to < 64 else F.col(key)).alias("probe"), F.col(key).alias("key")


def _below(keys: list[str], splitter: tuple[int, ...]) -> Column:
    test = F.lit(False)
    for name, value in reversed(list(zip(keys, splitter, strict=True))):
        test = (F.col(name) < value) | ((F.col(name) == value) & test)
    return test


def _numbered(df: DataFrame, keys: list[str], splitters: list[tuple[int, ...]]) -> DataFrame:
    """`df` with __nth: 0, but in the groups of equal rows that a splitter cuts, their numbers from 0.

    The rows of such a group are gathered to one with a count, which is partial first, and dealt out again.
    """
    cut = sorted({x[:-1] for x in splitters if 0 < x[-1] < _HIGHEST})
    if not cut:
        return df.withColumn("__nth", F.lit(0).cast("long"))
    inside = F.lit(False)
    for values in cut:
        same = F.lit(True)
        for name, value in zip(keys, values, strict=True):
            same &= F.col(name) == value
        inside |= same
    carried = [c for c in df.columns if c not in keys]
    equal = df.where(inside).groupBy(*keys).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in carried])).alias("__x"), F.count("*").alias("__c"))
    equal = equal.select(*keys, "__x.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)).alias("__nth"))
    return df.where(~inside).withColumn("__nth", F.lit(0).cast("long")).unionByName(equal)


def _shard_of(keys: list[str], splitters: list[tuple[int, ...]], low: int = 0) -> Column:
    """The number of splitters at or below a row's key, by bisection."""
    if not splitters:
        return F.lit(low)
    mid = len(splitters) // 2
    return F.when(_below(keys, splitters[mid]), _shard_of(keys, splitters[:mid], low)).otherwise(_shard_of(keys, splitters[mid + 1 :], low + mid + 1))


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, overhead: int = 8, slot_rows: int = 250_000, slot_bytes: int = 64 << 20) -> DataFrame:
    """`docs` (doc_id, text and any others) with size, shard and slot; columns of these names, in any case, are replaced, and none may begin with two underscores.

    size is the UTF-8 bytes of the text (null: none) plus `overhead`. Shards 0 to shards - 1 differ in
    bytes by no more than twice `tolerance` of a shard, or the size of a document where none is small
    enough; that holds for repeated rows as well. slot numbers a shard's rows from 0 without gaps. Equal texts are
    neighbours. Null texts sort as empty; an empty table stays empty. Slots are numbered in
    parts of about `slot_rows` rows or `slot_bytes` bytes, so no task sorts a whole shard unless its rows are equal in all columns.
    """
    work = Work(docs.sparkSession, "sharding")
    if taken := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns may not begin with two underscores: {taken}")
    names = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    keys = ["__text", "__id", "__row"]
    hashed = [F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in names])]
    sized = docs.select(*[F.col(f"`{c}`") for c in names], (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"), *[x.alias(k) for x, k in zip(hashed, keys, strict=True)])
    sizes = work.put(sized.select("size", *keys), "sizes")
    rows, total = sizes.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    splitters = _splitter(sizes, keys, [total * j / shards for j in range(1, shards)], tolerance * total / shards) if rows else []
    parts = max(1, -(-rows // (shards * slot_rows)), -(-total // (shards * slot_bytes)))
    every = [*keys, "__nth"]
    part = F.pmod(F.xxhash64(*every), F.lit(parts)).cast("int")
    placed = lambda df: _numbered(df, keys, splitters).withColumn("shard", _shard_of(every, splitters).cast("int")).withColumn("__part", part)
    order = Window.partitionBy("shard", "__part").orderBy(*every)
    out = placed(sized).withColumn("slot", F.row_number().over(order).cast("long") - 1)
    if parts > 1:
        counts = placed(sizes).groupBy("shard", "__part").agg(F.count("*").alias("c"))
        before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        counts = work.put(counts.withColumn("__before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c"), "counts")
        out = out.join(counts, ["shard", "__part"]).withColumn("slot", F.col("slot") + F.col("__before"))
    work.drop("sizes")
    return out.select(*names, "size", "shard", "slot")
