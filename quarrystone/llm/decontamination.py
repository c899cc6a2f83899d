"""Benchmark passages in training documents by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens that ignores some positions. Hashes of the tokens that
the masks select are built for every place of the benchmark items and looked up at every place of
every document; each hit fixes an item and an alignment, which is then verified token by token. The
two masks below hit every alignment that has at most two replaced tokens in some 13 (all 78 cases are
tested), so verification sees every overlap that counts. Short items have masks of their own: of 8 to 12
tokens with one replaced, the first four or the next four are intact; shorter ones are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm import text as T
from quarrystone.llm.work import Work

#: Places of each mask that count.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
WINDOW, EQUAL, SHORTEST = 13, 11, 8
#: Consecutive tokens of a seed of items of SHORTEST to WINDOW - 1 tokens.
HALF = SHORTEST // 2
_FACTORS = T.mix(np.arange(101, 111, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_FILTER_BITS = 22
#: Pairs of places of one seed that are listed.
_LISTED = 1 << 14


def seeds(h: np.ndarray, first: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a mask at every place where it stays within its text."""
    span = mask[-1] + 1
    at = np.arange(len(h) - span + 1)
    if not len(at):
        return np.zeros(0, np.uint64), at
    end = np.repeat(first[1:], np.diff(first))
    at = at[at + span <= end[at]]
    total = np.full(len(at), salt, np.uint64)
    for j, place in enumerate(mask):
        total += h[at + place] * _FACTORS[j]
    return T.mix(total), at


class Items:
    """Benchmark items as tokens, and their seeds in order of hash; `masks` are those in use, with their salts."""

    def __init__(self, ids: list[int], texts: list[str], short: bool = False, least_tokens: int = 1):
        table = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
        hashes, count = [np.zeros(0, np.uint64)], []
        for _, data, offsets in T.chunks(table):
            w = T.Words(data, offsets, between=T.PUNCTUATION)
            hashes.append(w.hash)
            count.append(np.diff(w.first))
        self.ids = np.array(ids, np.int64)
        self.tokens = np.concatenate(hashes)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *count]))]).astype(np.int64)
        self.short = short
        self.masks = [(m, i + 1) for i, m in enumerate(MASKS)]
        parts = [seeds(self.tokens, self.first, m, salt) for m, salt in self.masks]
        size, begin = np.diff(self.first), self.first[:-1]
        some = begin[(size >= SHORTEST) & (size < WINDOW)]
        for n, places in [*[(n, begin[size == n]) for n in range(max(1, least_tokens), SHORTEST)], (HALF, np.concatenate([some, some + HALF]))] if short else ():
            if len(places):
                self.masks.append((tuple(range(n)), len(MASKS) + len(self.masks)))
                key, at = seeds(self.tokens, self.first, *self.masks[-1])
                own = np.isin(at, places)
                parts.append((key[own], at[own]))
        key, at = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], at[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, words: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, place in the chunk's words where the item would begin), in blocks of about a million at most.

        A seed that a text and the items repeat hits at so many pairs of places that they aren't listed: its alignments are marked
        in an array over the places instead, item by item.
        """
        marked: dict[int, list[np.ndarray]] = {}
        for mask, salt in self.masks:
            key, at = seeds(words.hash, words.first, mask, salt)
            near = np.flatnonzero(self.filter[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            key, at = key[near], at[near]
            low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            n = high - low
            use = n > 0
            low, n, at = low[use], n[use], at[use]
            own, of, places = np.unique(low, return_inverse=True, return_counts=True)
            size = np.zeros(len(own), np.int64)
            size[of] = n
            heavy = np.flatnonzero((places > 64) & (places * size > _LISTED))
            for k in heavy.tolist():
                p = at[of == k]
                entries = np.arange(own[k], own[k] + size[k])
                for item in np.unique(self.item[entries]).tolist():
                    offset = self.at[entries[self.item[entries] == item]] - self.first[item]
                    base = p[0] - offset.max()
                    on = np.zeros(p[-1] - offset.min() - base + 1, bool)
                    for x in offset.tolist():
                        on[p - (base + x)] = True
                    marked.setdefault(item, []).append(np.flatnonzero(on) + base)
            if len(heavy):
                rest = ~np.isin(of, heavy)
                low, n, at = low[rest], n[rest], at[rest]
            block = np.cumsum(n) >> 20
            for b in np.unique(block):
                k = block == b
                entry = np.repeat(low[k] - (np.cumsum(n[k]) - n[k]), n[k]) + np.arange(n[k].sum())
                item = self.item[entry]
                yield item, np.repeat(at[k], n[k]) - (self.at[entry] - self.first[item])
        for item, parts in marked.items():
            begin = np.unique(np.concatenate(parts))
            yield np.full(len(begin), item), begin

    def verified(self, words: T.Words) -> np.ndarray:
        """Rows (text, item, equal tokens of the best window, equal tokens, first and last word of the overlap): of each text and item, the best alignment that counts, ties to the first.

        Hits are verified block by block, and an item that a text holds whole is not looked at further on in it.
        """
        best = np.zeros((0, 6), np.int64)
        step = max(1, (1 << 20) // max(1, int(np.diff(self.first).max(initial=1))))
        for item, begin in self.hits(words):
            pairs = np.unique(np.stack([item, begin], 1), axis=0)
            for a in range(0, len(pairs), step):
                item, begin = pairs[a : a + step, 0], pairs[a : a + step, 1]
                if len(best) and a:
                    # Alignments come in order of place, so only those of texts behind the place can be done.
                    whole = best[best[:, 3] == np.diff(self.first)[best[:, 1]]]
                    text = np.searchsorted(words.first, np.maximum(begin, 0), "right") - 1
                    code = lambda t, i: t * len(self.first) + i
                    later = np.isin(code(text, item), code(whole[:, 0], whole[:, 1]))
                    inside = begin + self.first[item + 1] - self.first[item] <= words.first[np.minimum(text + 1, len(words.first) - 1)]
                    at = dict(zip(code(whole[:, 0], whole[:, 1]).tolist(), whole[:, 4].tolist(), strict=True))
                    skip = later & inside
                    skip[skip] = [at[c] < b for c, b in zip(code(text, item)[skip].tolist(), begin[skip].tolist(), strict=True)]
                    item, begin = item[~skip], begin[~skip]
                if len(item):
                    best = np.concatenate([best, self._align(words, item, begin)])
                    best = best[np.lexsort((best[:, 4], -best[:, 3], -best[:, 2], best[:, 1], best[:, 0]))]
                    new = np.ones(len(best), bool)
                    new[1:] = (best[1:, :2] != best[:-1, :2]).any(1)
                    best = best[new]
        return best

    def _align(self, words: T.Words, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        size = self.first[item + 1] - self.first[item]
        row = np.repeat(np.arange(len(item)), size)
        start = np.cumsum(size) - size
        k = np.arange(len(row)) - start[row]
        place = begin[row] + k
        ok = (place >= 0) & (place < len(words.hash))
        place = np.where(ok, place, 0)
        text = np.searchsorted(words.first, place, "right") - 1
        equal = ok & (words.hash[place] == self.tokens[self.first[item][row] + k]) if len(words.hash) else ok
        total = np.concatenate([[0], np.cumsum(equal)])
        length = np.minimum(WINDOW, size)[row]
        fits = k + length <= size[row]
        stop = np.where(fits, np.arange(len(row)) + length, np.arange(len(row)) + 1)
        same = text[stop - 1] == text
        score = np.where(fits, total[stop] - total[:-1], 0)
        need = np.where(size >= WINDOW, EQUAL, size - (self.short & (size >= SHORTEST)))[row]
        good = np.flatnonzero(fits & ok & ok[stop - 1] & same & (score >= need))
        if not len(good):
            return np.zeros((0, 6), np.int64)
        # An alignment over a text's end can hold windows of two texts: they are told apart by the text.
        group = row[good].astype(np.int64) * (len(words.first) + 1) + text[good]
        keys, at, inverse = np.unique(group, return_index=True, return_inverse=True)
        best = np.zeros(len(keys), np.int64)
        np.maximum.at(best, inverse, score[good])
        low, high = np.full(len(keys), 1 << 62), np.zeros(len(keys), np.int64)
        np.minimum.at(low, inverse, place[good])
        np.maximum.at(high, inverse, place[good] + length[good] - 1)
        mine = np.flatnonzero(equal)
        own = row[mine].astype(np.int64) * (len(words.first) + 1) + text[mine]
        total_equal = np.searchsorted(np.sort(own), keys, "right") - np.searchsorted(np.sort(own), keys, "left")
        return np.stack([text[good][at], item[row[good][at]], best, total_equal, low, high], 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_tokens: int = 500_000, short: bool = False, least_tokens: int = 1) -> DataFrame:
    """doc_id, item_id, best_window, equal_tokens, start, end (characters): the overlaps of documents with benchmark items, a row per pair and its best alignment.

    Tokens are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. A pair counts if some
    aligned 13 tokens of both agree in 11 or more. With `short`, an item of 8 to 12 tokens may have one replaced (as
    2 of 13, rounded down), and a shorter one must occur whole, even one of a single token; without, one of 8 to 12
    must occur whole, and a shorter one is not looked for. Items of fewer than `least_tokens` tokens are not looked for in either case: a corpus
    may well hold the words of very short ones by chance. Distinct texts of items are sent to the tasks as arrays of at most about `block_tokens` tokens; a larger benchmark is
    dealt into blocks by a hash of its texts, and the documents are scanned once for each. Items without an id or text have no overlaps, nor have null or blank
    documents; rows that repeat a doc_id, those without one among them, give one row per item.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    # A text that many items have is sent once.
    texts = Work(spark, "decontamination").put(items.select("text").distinct().withColumn("number", F.monotonically_increasing_id()), "texts")
    size = texts.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no token is shorter than a character and a gap
    blocks = max(1, math.ceil(size / block_tokens))
    found = None
    for b in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("text").collect()
        sent = spark.sparkContext.broadcast(Items([r.number for r in rows], [r.text for r in rows], short, least_tokens))
        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.trimmed(_scan(sent)), "doc_id long, number long, best_window long, equal_tokens long, start long, end long")
        found = part if found is None else found.union(part)
    best = F.max(F.struct("best_window", "equal_tokens", (-F.col("start")).alias("s"), "end")).alias("m")
    found = found.groupBy("doc_id", "number").agg(best).join(texts.join(items, "text").select("number", "item_id"), "number")
    return found.select("doc_id", "item_id", "m.best_window", "m.equal_tokens", (-F.col("m.s")).alias("start"), "m.end")


def _scan(sent):
    def run(batches):
        items = sent.value
        names = ["doc_id", "number", "best_window", "equal_tokens", "start", "end"]
        for batch in batches:
            for rows, data, offsets in T.chunks(batch):
                w = T.Words(data, offsets, between=T.PUNCTUATION)
                found = items.verified(w)
                if not len(found):
                    continue
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[offsets[found[:, 0]]]
                cols = [items.ids[found[:, 1]], found[:, 2], found[:, 3], chars[w.start[found[:, 4]]] - base, chars[w.end[found[:, 5]]] - base]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(found[:, 0])), *[pa.array(x, pa.int64()) for x in cols]], names)

    return run
