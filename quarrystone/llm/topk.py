"""Exact top-k inner products with an impact-ordered index, score at a time.

A block of vectors is indexed by dimension: components are quantised to levels, and a segment holds a dimension's
postings of one level. For a query, a segment's impact is the largest product that its level allows. Segments of all
dimensions are processed by descending impact, each once: it adds its impact to the accumulators of its members, and
counts them. What is left of a vector then has products of at most the next impact, which bounds its score. A vector
whose bound is below the k-th best exact score so far can't be in the result. Processing stops once that is proven of
all but a few, and these possible members are rescored exactly.
"""


from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ImpactIndex:
    """Postings of a block of integer vectors, in segments of one quantised value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = 128):
        self.ids, self.x = ids, vectors.astype(np.float64)  # exact up to 2**53
        self.dims = vectors.shape[1]
        low, high = self.x.min(axis=0), self.x.max(axis=0)
        width = np.floor((high - low) / levels) + 1
        level = np.minimum((self.x - low) // width, levels - 1).astype(np.int64)
        #: By dimension, members in order of level.
        self.order = np.ascontiguousarray(np.argsort(level, axis=0, kind="stable").T)
        sizes = np.bincount((level + levels * np.arange(self.dims)).ravel(), minlength=self.dims * levels).reshape(-1, levels)
        #: Segment s of a dimension holds places cut[s] to cut[s + 1] of its order, and values from least[s] to most[s].
        self.cut = np.concatenate([np.zeros((self.dims, 1), np.int64), np.cumsum(sizes, axis=1)], axis=1)
        self.least = low[:, None] + np.arange(levels) * width[:, None]
        self.most = np.minimum(self.least + width[:, None] - 1, high[:, None])
        self.most[:, -1] = high
        #: The share of the last query's postings that were processed, and the number of vectors that were rescored.
        self.processed, self.rescored = 0.0, 0

    def top(self, q: np.ndarray, own: int, k: int, floor: float = -np.inf, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of at least the k best whose score is `floor` or more; `own` is left out."""
        n, levels = len(self.ids), self.cut.shape[1] - 1
        # A dimension's impacts fall from its highest level where the query is positive, else from its lowest.
        falls = q >= 0
        turned = falls[:, None]
        impact = q[:, None] * np.where(turned, self.most[:, ::-1], self.least)
        ends = np.where(turned, n - self.cut[:, ::-1], self.cut)
        sizes = np.diff(ends, axis=1)
        every, segment = np.arange(self.dims), np.arange(levels)
        took = np.zeros(self.dims, np.int64)
        total, count = np.zeros(n), np.zeros(n, np.int64)  # of a vector's processed segments: the sum of impacts, and how many
        possible = np.flatnonzero(self.ids != own)
        for least in _thresholds(np.abs(impact).max(), steps):
            now = (impact >= least).sum(axis=1)
            a, b = ends[every, took], ends[every, now]
            dims = np.flatnonzero(b > a)
            if not len(dims):
                took = now
                continue
            parts = [self.order[d, n - b[d] : n - a[d]][::-1] if falls[d] else self.order[d, a[d] : b[d]] for d in dims.tolist()]
            parts = np.concatenate(parts)
            new = (segment >= took[:, None]) & (segment < now[:, None])
            total += np.bincount(parts, np.repeat(impact[new], sizes[new]), n)
            count += np.bincount(parts, minlength=n)
            took = now
            # Dimensions that were begun allow each vector not yet met in them the next impact, the others their first.
            begun, left = took > 0, (took > 0) & (took < levels)
            rest = impact[left, took[left]].max() if left.any() else 0.0
            upper = (total + rest * (begun.sum() - count) + impact[~begun, 0].sum())[possible]
            if len(possible) > k:
                best = possible[np.argpartition(-upper, k - 1)[:k]]
                floor = max(floor, np.min(self.x[best] @ q))
            possible = possible[upper >= floor]
            if len(possible) <= max(4 * k, n // 32):
                break
        self.processed, self.rescored = ends[every, took].sum() / max(1, n * self.dims), len(possible)
        score = self.x[possible] @ q
        if len(score) > k:
            floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
        keep = score >= floor
        return self.ids[possible[keep]], score[keep]


def _thresholds(peak: float, steps: int) -> list[float]:
    """Impacts down to which segments are processed before each look at the bounds; closer together near 0, where most postings are."""
    return [peak * s * abs(s) / steps**2 for s in range(steps - 1, -steps, -1)] + [-np.inf]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 16_384, query_block: int = 8_192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    vectors, queries: vec_id, embedding. A component x counts as floor(scale * x). All of a query's candidates are the
    vectors of another vec_id (all, if fewer than k). Of vectors of different lengths the shorter one goes on with zeros. Vectors that
    are null, without a vec_id, or that hold null or non-finite components take no part on either side; other
    columns are ignored; vectors that repeat a vec_id count each; query rows equal in vec_id and components are one query, and others that
    repeat a vec_id have a result each; without vectors or queries there is no result. Queries are sent to the tasks in blocks of
    about `query_block`, and tasks index blocks of `block` vectors, fewer where vectors are long, so memory is bounded. Scores are exact up to
    2**53: components whose products could go beyond raise ValueError.
    """
    spark = vectors.sparkSession
    vectors, queries = (_usable(df, scale) for df in (vectors, queries))
    queries = queries.dropDuplicates(["vec_id", "v"])
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    asked, dims, peak = queries.agg(F.count("*"), F.max(F.size("v")), largest).first()
    if asked and (reach := vectors.agg(largest).first()[0]) and dims * (peak or 0) * reach > 2**53:
        raise ValueError(f"components times {scale} reach {peak} in queries and {reach} in vectors: inner products of {dims} do not fit 53 bits")
    schema = "query long, query_id long, vec_id long, score long"
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, dims)
    block = max(1, min(block, (1 << 20) // dims))
    blocks = -(-asked // max(1, min(query_block, (1 << 19) // dims)))
    found = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast((mine["vec_id"].to_numpy(np.int64), _matrix(pa.array(mine["v"], pa.list_(pa.int64())), dims).astype(np.float64)))
        part = vectors.mapInArrow(_search(sent, dims, k, block, b << 32), schema)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(df: DataFrame, scale: int) -> DataFrame:
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    df = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(v: pa.ListArray, dims: int) -> np.ndarray:
    """A row of `dims` components for each list: longer ones are cut, as no query has more, and shorter ones go on with zeros."""
    flat, lengths = v.flatten().to_numpy(), v.value_lengths().to_numpy()
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[at < dims], at[at < dims]] = flat[at < dims]
    return out


def _search(sent, dims: int, k: int, block: int, number: int):
    """Finds the best of each query sent; queries are numbered from `number`."""

    def run(batches):
        ids, q = sent.value
        floor = np.full(len(ids), -np.inf)  # each query's k-th best score so far, over this task's blocks
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]
        held: list[pa.RecordBatch] = []

        def work():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            index = ImpactIndex(table.column("vec_id").to_numpy(), _matrix(table.column("v").chunk(0), dims))
            for i in range(len(ids)):
                best[i].append(index.top(q[i], ids[i], k, floor[i]))
                vec, score = (np.concatenate([p[j] for p in best[i]]) for j in range(2))
                first = np.lexsort((vec, -score))[:k]
                best[i] = [(vec[first], score[first])]
                if len(first) == k:
                    floor[i] = score[first[-1]]

        for batch in batches:
            for a in range(0, batch.num_rows, block):
                held.append(batch.slice(a, block))
                if sum(x.num_rows for x in held) >= block:
                    work()
        if sum(x.num_rows for x in held):
            work()
        rows = [(np.full(len(vec), number + i), np.full(len(vec), ids[i]), vec, score) for i in range(len(ids)) for vec, score in best[i]]
        if rows:
            query, of, vec, score = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(of), pa.array(vec), pa.array(score.astype(np.int64))], ["query", "query_id", "vec_id", "score"])

    return run
