"""SentencePiece ids of whole texts, and texts of ids.

Where no piece of a model can hold a whitespace marker behind another character, a text's segmentation is that of
its marked words (a run of markers with what follows up to the next run), each by itself. A task keeps a table of the
distinct marked words it has met, by their characters, segments each once, and joins the ids back by position. No
row is shuffled: a table over all tasks would have to move every word of the corpus to save a few calls.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quarrystone.llm import text as T
from quarrystone.llm.columns import named, others

MARK = "▁"
_MARKED = re.compile(" +[^ ]*")
_models: dict[str, Segmenter] = {}


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Segmenter:
    """Ids as SentencePieceProcessor(model_file=path).encode(text) gives them, without begin or end ids."""

    def __init__(self, path: str, table_bytes: int = 24 << 20, longest: int = 64):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        #: Marked words by their characters; longer ones are segmented where they stand.
        self.table: dict[str, bytes] = {}
        self.longest = longest
        #: What the table holds, and may hold, in bytes of Python objects.
        self.held, self.limit = 0, table_bytes
        self.separable = self._separable()

    def _separable(self) -> bool:
        """Whether marked words are segmented alike wherever they stand: a merge model, no rewriting of characters, a marker before the text, and no piece with a marker behind another character."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        how, kind = model.normalizer_spec, model.trainer_spec
        plain = kind.model_type == kind.BPE and kind.byte_fallback and not kind.treat_whitespace_as_suffix and not how.precompiled_charsmap
        plain = plain and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
        pieces = [p for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
        plain = plain and all(p.type == p.NORMAL for p in pieces) and any(p.piece == MARK for p in pieces)
        return plain and not any(MARK in p.piece.lstrip(MARK) or " " in p.piece for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        if not self.separable or not text:
            return np.array(self.library.encode(text), np.uint32)
        # The model puts a marker before the text, and reads a marker in it as a space.
        words = _MARKED.findall(" " + text.replace(MARK, " "))
        table = self.table
        got = list(map(table.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self._segment(words[i])
        return np.frombuffer(b"".join(got), np.uint32)

    def _segment(self, word: str) -> bytes:
        known = self.table.get(word)
        if known is not None:
            return known
        ids = np.array(self.library.encode(word[1:]) if len(word) > 1 else [self.library.piece_to_id(MARK)], np.uint32).tobytes()
        if len(word) <= self.longest:
            if self.held > self.limit:
                self.table.clear()
                self.held = 0
            self.table[word] = ids
            self.held += 210 + 4 * len(word) + len(ids)
        return ids

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def _segmenter(path: str) -> Segmenter:
    return _models.get(path) or _models.setdefault(path, Segmenter(path))


def encode_texts(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with `ids` (array of int) in place of the column `text`: the ids of each whole text, as the library gives them.

    `model` is a SentencePiece model's path, by default the public one with byte fallback. A null or empty text has no
    ids; bytes that are not UTF-8 are read as U+FFFD. Rows are kept as they are, repeated ones and nulls in other columns
    included; a column that has the name of `ids` is replaced. A text of any length is segmented whole.
    Models whose marked words cannot be parted are run on whole texts.
    """
    path = model or public_model()
    kept = others(docs, text, ids)
    rows = docs.select(*[f"`{c}`" for c in kept], F.col(f"`{named(docs, text)}`").cast("string").cast("binary").alias("__text"))

    def run(batches):
        segmenter = _segmenter(path)
        for batch in batches:
            for part, data, offsets in T.chunks(batch, "__text"):
                raw = data.tobytes()
                found = [segmenter.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets, offsets[1:], strict=False)]
                ends = np.cumsum([0, *map(len, found)])
                values = np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], T.lists(values, ends)], [*kept, ids])

    return rows.mapInArrow(T.trimmed(run), StructType([*rows.schema.fields[:-1], StructField(ids, ArrayType(IntegerType()))]))


def decode_ids(docs: DataFrame, model: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with a column `text`: the library's text of each row's whole list of `ids`.

    A null or empty list has an empty text, and null ids in a list are left out. An id that the model does not have
    raises the library's error. A column that has the name of `text` is replaced.
    """
    path = model or public_model()
    kept, name = others(docs, ids, text), named(docs, ids)
    rows = docs.select(*[f"`{c}`" for c in kept], F.col(f"`{name}`").cast("array<int>").alias(name))

    def run(batches):
        segmenter = _segmenter(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # Few rows at a time, so that texts of many tokens do not pile up.
                to = min(at + 256, batch.num_rows)
                part = batch.slice(at, to - at)
                lists = part.column(part.num_columns - 1)
                texts = [segmenter.decode(x.values.drop_null().to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*kept, name, text])
                at = to

    return rows.mapInArrow(T.trimmed(run), StructType([*rows.schema.fields, StructField(text, StringType())]))
