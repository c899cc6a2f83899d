"""Token ids of a byte-level BPE over chunks of text.

Pre-tokens of a chunk are found by array operations on code points, each distinct one is encoded once and
remembered by its bytes, and ids are gathered by number. That holds for texts of the code points in _CLASS and of
vocabularies whose ids rank their merges; all other texts go to the tokenizer library itself.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np

from quarrystone.llm.text import Spans

LETTER, NUMBER, SPACE, OTHER, UNKNOWN, EDGE = 0, 1, 2, 3, 8, 9
_LIMIT = 0x2060
_EDGE_AT = _LIMIT + 1
_EDGE_CODE = 0xFFFFFFFF
#: Bytes of a cache entry besides its key and ids: a slot and two objects' heads. Longer pre-tokens are not kept.
_ENTRY, _KEPT = 180, 256
_SPACES = {*range(9, 14), 0x20, 0x85, 0xA0}


def _classes() -> np.ndarray:
    """Latin letters, digits, signs and general punctuation; what lies beyond is UNKNOWN."""
    table = np.full(_LIMIT + 2, UNKNOWN, np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        kind = unicodedata.category(chr(c))[0]
        table[c] = SPACE if c in _SPACES else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    table[_EDGE_AT] = EDGE
    return table


_CLASS = _classes()


class Encoder:
    """Ids as `Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids` gives them."""

    def __init__(self, path: str, cache_bytes: int = 32 << 20):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        #: Ids of pre-tokens by their bytes.
        self.cache: dict[bytes, bytes] = {}
        #: What the cache holds, and may hold, in bytes of Python objects.
        self.held, self.limit = 0, cache_bytes
        spec = json.loads(self.slow.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.piece = self._ranked(spec)

    def _ranked(self, spec: dict):
        """Encodes one pre-token, if the vocabulary is plain byte-level BPE whose ids rank its merges; else None."""
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
        plain = plain and not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"])
        if not plain:
            return None
        vocab = model["vocab"]
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(vocab) != 256 + len(made) or min(made, default=256) < 256:
            return None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(visible))}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): of texts laid end to end; malformed UTF-8 is read as U+FFFD."""
        raw = data.tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets, offsets[1:], strict=False)]
            raw = b"".join(texts)
            data, offsets, text = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64), raw.decode()
        n = len(offsets) - 1
        if self.piece is None:
            return self._join([x.ids for x in self._slow(raw, offsets, range(n))])
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = np.searchsorted(lead, offsets)
        # Text d's code points stand d + 1 places further on, behind an edge of its own.
        a = np.append(np.insert(codes, edges[:-1], _EDGE_CODE), np.uint32(_EDGE_CODE))
        edge = edges + np.arange(n + 1)
        kind = np.minimum(a, _LIMIT)
        kind[edge] = _EDGE_AT
        kind = _CLASS[kind]
        odd = set((np.searchsorted(edge, np.flatnonzero(kind == UNKNOWN), "right") - 1).tolist())
        for s in self.special:
            if s in text:
                odd |= {d for d in range(n) if s.encode() in raw[offsets[d] : offsets[d + 1]]}
        start, end = self._bounds(a, kind, edge)
        ids, count = self._gather(data, lead, start, end, edge)
        first = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, edge)]
        if odd:
            parts = [ids[first[d] : first[d + 1]] for d in range(n)]
            for d, x in zip(sorted(odd), self._slow(raw, offsets, sorted(odd)), strict=True):
                parts[d] = x.ids
            return self._join(parts)
        return ids, first

    def _slow(self, raw: bytes, offsets: np.ndarray, which) -> list:
        return self.slow.encode_batch_fast([raw[offsets[d] : offsets[d + 1]].decode() for d in which], add_special_tokens=False)

    @staticmethod
    def _join(parts: list) -> tuple[np.ndarray, np.ndarray]:
        first = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *[np.asarray(x, np.uint32) for x in parts]]), first

    @staticmethod
    def _bounds(a: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where pre-tokens start and end: runs of one class, with one space before letters, digits or signs; the other white space before them apart; contractions."""
        space = kind == SPACE
        solid = kind <= OTHER
        solid &= ~space
        b = np.ones(len(a), bool)
        b[1:] = kind[1:] != kind[:-1]
        b[1:] &= ~(solid[1:] & (a[:-1] == 32))
        b[:-1] |= space[:-1] & solid[1:]
        b[edge] = True
        b[edge[:-1] + 1] = True
        q = np.flatnonzero((a == 39) & b)
        if len(q):
            one = np.take(a, q + 1, mode="clip")
            two = np.take(a, q + 2, mode="clip")
            size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 2, 0)
            for x, y in ("re", "ve", "ll"):
                size[(one == ord(x)) & (two == ord(y))] = 3
            q, size = q[size > 0], size[size > 0]
            b[q + 1] = False
            b[q + size] = True
        at = np.flatnonzero(b)
        stop = np.append(at[1:], len(a))
        use = kind[at] != EDGE
        return at[use], stop[use]

    def _gather(self, data: np.ndarray, lead: np.ndarray, start: np.ndarray, end: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # From places among code points and edges to places among bytes.
        shift = np.repeat(np.arange(1, len(edge)), np.diff(np.searchsorted(start, edge)))
        lead = np.append(lead, len(data))
        low, high = lead[start - shift], lead[end - shift]
        at, inverse = Spans(data).distinct(low, high)
        if self.held > self.limit:
            self.cache.clear()
            self.held = 0
        cache, raw = self.cache, data.tobytes()
        keys = [raw[x:y] for x, y in zip(low[at].tolist(), high[at].tolist(), strict=True)]
        got = list(map(cache.get, keys))
        encode = self.piece
        for i, x in enumerate(got):
            if x is None:
                got[i] = array("I", encode(keys[i])).tobytes()
                if self.held <= self.limit and len(keys[i]) <= _KEPT:
                    cache[keys[i]] = got[i]
                    self.held += _ENTRY + len(keys[i]) + len(got[i])
        pool = np.frombuffer(b"".join(got), np.uint32)
        size = np.fromiter(map(len, got), np.int32, len(got)) >> 2
        count = size[inverse]
        shift = (np.cumsum(size, dtype=np.int32) - size)[inverse] - (np.cumsum(count, dtype=np.int32) - count)
        shift = np.repeat(shift, count)
        shift += np.arange(len(shift), dtype=np.int32)
        return pool[shift], count
