"""Toxic documents and their offending sentences by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence's probability is logistic in
hashed features of its words (the word and its first bytes, so that inflected forms share weight). The
document's is the noisy-or of its sentences', 1 - prod(1 - p), and training maximises the likelihood
of document labels under it, so blame moves to the sentences that explain them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrystone.llm import text as T
from quarrystone.llm.columns import named

BITS = 20
#: Bytes of a word's beginnings that are features of their own. Stems of seven letters, or with two-byte letters, need the longer ones.
PREFIXES = (4, 5, 6, 7, 8)
LEAST_WORDS = 3
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(x) for x in ".!?\n"]] = True


def _joined(starts: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n words the number of passages that began before its end, when the sentences that begin at `starts` join within a text until LEAST_WORDS."""
    begin = np.zeros(n, np.int64)
    have = LEAST_WORDS
    before, last = -1, 0
    for at, of in zip(starts.tolist(), text[starts].tolist(), strict=True):
        if of != before or at - last >= have:
            begin[at], before, last = 1, of, at
    return np.cumsum(begin)


class Sentences:
    """Sentences of a chunk that hold words: `features` by row, `first` (row of each sentence's first), `of` (text of each sentence), `start`, `end` (byte places)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = T.Words(data, offsets, between=T.PUNCTUATION)
        ends = np.concatenate([[0], np.cumsum(SENTENCE_END[data])])
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
        # A text starts a sentence, too: the id is the end marks before it plus the texts before it.
        place = ends[w.start] + text
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        # Sentences join until they have LEAST_WORDS: shouted lists of words are one passage, not many.
        place = text + _joined(np.flatnonzero(new), text, len(place))
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        at = np.flatnonzero(new)
        self.of = text[at]
        self.start = w.start[at]
        self.end = w.end[np.concatenate([at[1:], [len(place)]])[: len(at)] - 1] if len(at) else w.end[:0]
        length = w.end - w.start
        rows, words = [w.hash], [np.arange(len(place))]
        for n in PREFIXES:
            long = np.flatnonzero(length > n)
            rows.append(T.mix(w.spans(w.start[long], w.start[long] + n) + np.uint64(n)))
            words.append(long)
        sentence = np.cumsum(new) - 1
        hashed = (np.concatenate(rows) >> np.uint64(64 - BITS)).astype(np.int64)
        self.row = sentence[np.concatenate(words)]
        self.features = hashed
        self.count = len(at)


@dataclass
class ToxicityModel:
    """Weights of the hashed features that count; a feature not listed weighs 0."""

    bias: float
    features: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, epochs: int = 30, l1: float = 1.5e-4, seed: int = 7, holdout: int = 5) -> ToxicityModel:
        """Trains on a bounded sample of labelled rows.

        docs: doc_id, text; labels: doc_id, toxic (0 or 1; of several, the largest; null: none). Rows
        with crc32(doc_id as text) mod `holdout` = 0 are never used (0: all are). About `max_rows` rows are drawn by a
        hash of doc_id, half of each class if there are so many (of texts that share a doc_id, the first in order), whole, and weighted back to
        the classes' shares. `epochs` and
        `l1`, the penalty that keeps weights at 0, were chosen by log loss on folds inside the training rows. Without
        labels, or with one class, the model knows only that share.
        """
        spark = docs.sparkSession
        fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % holdout if holdout else F.lit(1)
        marked = labels.where("doc_id is not null and toxic is not null").where(fold != 0).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
        total = {r.y: r.c for r in marked.groupBy("y").agg(F.count("*").alias("c")).collect()}
        draw = lambda share: F.xxhash64("doc_id").cast("double") < (share * 2 - 1) * float(1 << 63)
        half = max_rows // 2
        quota = {y: max(half, max_rows - total.get(1 - y, 0)) for y in (0, 1)}
        share = {y: min(1.0, quota[y] / max(1, total.get(y, 0))) for y in (0, 1)}
        drawn = marked.where(F.when(F.col("y") == 1, draw(share[1])).otherwise(draw(share[0])))
        # About max_rows pairs of numbers: documents stay where they are, and only those drawn move.
        rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
        rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # a doc_id that repeats without end is one row
        table = rows.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        y = table.column("y").to_numpy().astype(np.int64)
        if not len(y):
            return ToxicityModel(-20.0 if not total.get(1) else 0.0, np.zeros(0, np.int64), np.zeros(0))
        every = np.where(y == 1, 1 / share[1], 1 / share[0])
        texts = table.column("text").combine_chunks()
        del table
        model = ToxicityModel._train(texts, y, every, epochs, seed, l1)
        T.trim()
        return model

    @staticmethod
    def _train(texts: pa.Array | list[str], y: np.ndarray, every: np.ndarray, epochs: int, seed: int, l1: float) -> ToxicityModel:
        order = np.random.default_rng(seed).permutation(len(texts))
        texts, y, every = (texts if isinstance(texts, pa.Array) else pa.array(texts)).cast(pa.large_string()).take(pa.array(order)), y[order], every[order]
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        # A feature of one or two documents tells nothing that carries over; the first pass finds the others.
        held = np.zeros(1 << BITS, np.int32)
        for _, data, offsets in T.chunks(batch, limit=T.CHUNK // 4):
            s = Sentences(data, offsets)
            held += np.bincount(np.unique((s.of[s.row] << BITS) | s.features) & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        known = np.flatnonzero(held >= 3)
        del held
        number = np.full(1 << BITS, -1, np.int32)
        number[known] = np.arange(len(known))
        # Of each sentence its text and its number of features, and the features one after the other.
        parts, done = [], 0
        for rows, data, offsets in T.chunks(batch, limit=T.CHUNK // 4):
            s = Sentences(data, offsets)
            use = np.flatnonzero(number[s.features] >= 0)
            pairs = np.unique((s.row[use] << BITS) | s.features[use])
            parts.append((number[pairs & ((1 << BITS) - 1)], np.bincount(pairs >> BITS, minlength=s.count).astype(np.int32), (s.of + done).astype(np.int32)))
            done += rows.num_rows
        n_texts = len(texts)
        del batch, texts, number, s, use, pairs
        feature, count, of = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        w, g2 = np.zeros(len(known)), np.full(len(known), 1e-6)
        bias, b2, rate = -4.0, 1e-6, 0.3
        size = max(16, min(256, n_texts // 40))
        doc_row = np.searchsorted(of, np.arange(n_texts + 1))
        row_at = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        weight = every / every.mean()
        for _ in range(max(epochs, 40_000 // n_texts)):  # small samples need more passes
            for a in range(0, n_texts, size):
                b = min(a + size, n_texts)
                r0, r1 = doc_row[a], doc_row[b]
                f, local = feature[row_at[r0] : row_at[r1]], np.repeat(np.arange(r1 - r0), count[r0:r1])
                z = np.clip(bias + np.bincount(local, w[f], r1 - r0), -30, 30)
                sure = np.bincount(of[r0:r1] - a, np.logaddexp(0, z), b - a)
                slope = np.where(y[a:b] == 1, -1 / np.maximum(np.expm1(np.minimum(sure, 30)), 1e-3), 1.0) * weight[a:b]
                dz = slope[of[r0:r1] - a] / (1 + np.exp(-z)) / (b - a)
                g = np.bincount(f, dz[local], len(known))
                g2 += g * g
                step = rate / np.sqrt(g2)
                w = w - step * g
                w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
                gb = dz.sum()
                b2 += gb * gb
                bias -= rate / np.sqrt(b2) * gb
        on = np.flatnonzero(w)
        return ToxicityModel(float(bias), known[on], w[on])

    def score(self, docs: DataFrame) -> DataFrame:
        """`docs` with score (the noisy-or of the sentences; 0 without words) and offending: start, end (characters) and score of each sentence that is toxic on its own (0.5 or more).

        Needs text; other columns are carried along, and columns named score or offending are replaced. A null text counts as empty.
        """
        docs = docs.drop("score", "offending")
        column = named(docs, "text")
        schema = StructType([*docs.schema.fields, *StructType.fromDDL("score double, offending array<struct<start:int,end:int,score:double>>").fields])
        bias, features, weights = self.bias, self.features, self.weights

        def run(batches):
            table = np.zeros(1 << BITS)
            table[features] = weights
            for batch in batches:
                for rows, data, offsets in T.chunks(batch, column):
                    s = Sentences(data, offsets)
                    n = len(offsets) - 1
                    # A feature counts once a sentence, as in training; only those with a weight matter.
                    hit = np.flatnonzero(table[s.features])
                    pairs = np.unique((s.row[hit].astype(np.int64) << BITS) | s.features[hit])
                    z = bias + np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], s.count)
                    score = -np.expm1(-np.bincount(s.of, np.logaddexp(0, z), n))
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    bad = np.flatnonzero(p >= 0.5)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(bad) else None
                    spans = [(), (), ()]
                    if len(bad):
                        base = chars[offsets[s.of[bad]]]
                        spans = [chars[s.start[bad]] - base, chars[s.end[bad]] - base, p[bad]]
                    struct = pa.StructArray.from_arrays([pa.array(spans[0], pa.int32()), pa.array(spans[1], pa.int32()), pa.array(spans[2], pa.float64())], ["start", "end", "score"])
                    at = np.searchsorted(s.of[bad], np.arange(n + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score), pa.ListArray.from_arrays(pa.array(at), struct)], [*rows.schema.names, "score", "offending"])

        return docs.mapInArrow(T.trimmed(run), schema)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of `docs` that aren't toxic, with their own columns only."""
        names = docs.columns
        text = named(docs, "text")
        return self.score(docs.toDF(*[f"c{i}" if x != text else "text" for i, x in enumerate(names)])).where("score < 0.5").drop("score", "offending").toDF(*names)
