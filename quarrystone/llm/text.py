"""Words and their hashes over Arrow batches of text, without a Python object for each word.

A chunk is a run of whole texts of about CHUNK bytes (more where one text is longer), laid end to
end as UTF-8 bytes; a null text counts as empty. A word is hashed eight bytes at a time, each mixed with what came
before, so that words of up to eight bytes and one length never collide, and no pattern of letters cancels out.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Small chunks are as fast as large ones, and a worker that two cores share stays small.
CHUNK = 1 << 19
#: Longer words are hashed one by one.
LONG = 64
#: By a number of bytes: that many of a lane.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def trimmed(run: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back at a task's end: workers serve many stages, and would keep the peak of each."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes between words: the space and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: The same and all ASCII that is neither letter nor digit.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[x for x in range(128) if not chr(x).isalnum()]] = True


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): whole texts of about `limit` bytes in all."""
    i = batch.schema.get_field_index(column)
    if i < 0:
        raise ValueError(f"one column {column} is needed, not {batch.schema.names}")
    a = batch.column(i)
    if a.null_count:
        a = a.fill_null("")
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    if not len(a):
        return
    offsets = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        part = offsets[at : to + 1]
        yield batch.slice(at, to - at), data[part[0] : part[-1]], part - part[0]
        at = to


class Spans:
    """Spans of bytes of a chunk: their hashes, and which of them are equal."""

    __slots__ = ("data", "lanes")

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        #: The eight bytes that begin at each place.
        self.lanes = np.ndarray((len(data) + 1,), "<u8", self.data, 0, (1,))

    def _lane(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.lanes[start] & _LOW[np.minimum(size, 8)]

    def _bytes(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal bytes wherever they stand."""
        size = end - start
        h = mix(mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ self._lane(start, size))
        live = np.flatnonzero(size > 8)
        at = 8
        while len(live) and at < LONG:
            h[live] = mix(h[live] ^ self._lane(start[live] + at, size[live] - at))
            at += 8
            live = live[size[live] > at]
        for i in live.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self._bytes(start[i], end[i]), digest_size=8).digest(), "little")
        return h

    def distinct(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, of): the places in `start` of spans that hold all distinct ones, and for each span which of them it equals, byte by byte."""
        size = end - start
        short = size < 8
        # A short span with its size is its own key; the others' keys lie beyond those.
        key = np.where(short, self._lane(start, size) | size.astype(np.uint64) << np.uint64(56), self.hash(start, end) | np.uint64(1 << 63))
        _, at, of = np.unique(key, return_index=True, return_inverse=True)
        other = at[of]
        live = np.flatnonzero(~short & (other != np.arange(len(of))))
        wrong = [live[size[live] != size[other[live]]]]
        live = live[size[live] == size[other[live]]]
        step = 0
        while len(live) and step < LONG:
            same = self._lane(start[live] + step, size[live] - step) == self._lane(start[other[live]] + step, size[live] - step)
            wrong.append(live[~same])
            step += 8
            live = live[same & (size[live] > step)]
        wrong.append(np.array([i for i in live.tolist() if self._bytes(start[i], end[i]) != self._bytes(start[other[i]], end[other[i]])], np.int64))
        wrong = np.concatenate(wrong)
        of[wrong] = len(at) + np.arange(len(wrong))
        return np.concatenate([at, wrong]), of


class Words:
    """Words of a chunk, with A-Z folded: `start`, `end` (byte places), `hash`, and `first` (each text's first word; one entry more than texts)."""

    __slots__ = ("start", "end", "hash", "first", "spans")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANK):
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        gap = np.ones(n + 2, bool)
        gap[1:-1] = between[data]
        inside = ~gap[1:-1]
        self.start = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        self.spans = Spans(_FOLD[data]).hash
        self.hash = self.spans(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)


_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's runs of k words in order; of 1 to k - 1 words, the whole text as one run."""
    h, first = words.hash, words.first
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    out = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(first[:-1] - out[:-1], runs) + np.arange(out[-1])
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    total = np.zeros(out[-1], np.uint64)
    for j in range(k):
        total += padded[begin + j] * _PLACES[j]
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = h[first[i] : first[i + 1]]
        total[out[i]] = (own * _PLACES[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(total), out


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
