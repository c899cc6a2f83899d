"""Functions that need Python: Arrow-batched scalar, aggregate and table functions, and text of HTML."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(code points by row and place, ended by zeros; lengths)."""
    parts = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts]
    size = np.array([len(x) for x in parts], np.int64)
    out = np.zeros((len(parts), size.max(initial=0)), np.int64)
    for i, x in enumerate(parts):
        out[i, : len(x)] = x
    return out, size


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insertions, deletions, replacements and swaps of neighbours (Damerau-Levenshtein) that turn one text into the other; null of null.

    The table of distances is filled for all pairs of a batch at once, place by place.
    """
    known = a.notna() & b.notna()
    (x, n), (y, m) = _codes(a[known]), _codes(b[known])
    rows = np.arange(len(n))
    far = n + m
    # d[:, i + 1, j + 1] is the distance of the first i and the first j; the borders before them are too far to use.
    d = np.zeros((len(n), x.shape[1] + 2, y.shape[1] + 2), np.int64)
    d[:, 0, :] = far[:, None]
    d[:, :, 0] = far[:, None]
    d[:, 1:, 1], d[:, 1, 1:] = np.arange(x.shape[1] + 1), np.arange(y.shape[1] + 1)
    alphabet, code = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    x, y = code[: x.size].reshape(x.shape), code[x.size :].reshape(y.shape)
    seen = np.zeros((len(n), len(alphabet)), np.int64)  # the last place in the one text of each letter
    for i in range(1, x.shape[1] + 1):
        match = np.zeros(len(n), np.int64)  # the last place in the other of this letter
        for j in range(1, y.shape[1] + 1):
            k, low = seen[rows, y[:, j - 1]], match.copy()
            same = x[:, i - 1] == y[:, j - 1]
            match[same] = j
            swap = d[rows, k, low] + (i - k - 1) + 1 + (j - low - 1)
            d[:, i + 1, j + 1] = np.minimum.reduce([d[:, i, j] + ~same, d[:, i + 1, j] + 1, d[:, i, j + 1] + 1, swap])
        seen[rows, x[:, i - 1]] = i
    out = pd.Series([None] * len(a), a.index, "Int64")
    out[known] = d[rows, n + 1, m + 1]
    return out


@F.udtf
class Balance:
    """For each row of a table that is dealt by a key and in order: the key, the row's id and a balance that adds `change` and is never below 0."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        """Takes a table with columns key, id and change; deals it by the key, in order of at and id."""
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        schema = StructType([StructField("key", kinds["key"]), StructField("id", kinds["id"]), StructField("balance", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("at"), OrderingColumn("id")])

    def __init__(self):
        self.balance = 0

    def eval(self, row: Row):
        self.balance = max(0, self.balance + (row["change"] or 0))
        yield row["key"], row["id"], self.balance


def products_aggregate(df: DataFrame, by: str, vector: str, scale: int = 1024, most: int = 64) -> DataFrame:
    """(by, n, dims, products): of each group's vectors x, their number and the sums of floor(scale x_i) * floor(scale x_j), row by row of the matrix, as whole numbers.

    An aggregate in Python that is partial first: a task adds up a matrix a group (and gives those it holds on when there are `most`), so a group of any size shuffles a few
    matrices a task, and the merge is the same function over few rows. Vectors that are null or hold null or non-finite components are left out, shorter ones go on with zeros; a null group is one.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(by).alias("g"), F.when(sound, F.transform(x, lambda v: F.floor(v * scale))).alias("v")).where("v is not null")

    def grown(m: np.ndarray, dims: int) -> np.ndarray:
        return m if len(m) >= dims else np.pad(m, (0, dims - len(m)))

    def summed(parts: Iterator[tuple[object, int, np.ndarray]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def give():
            out = [(k, n, len(m), m.ravel().tolist()) for k, (n, m) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["g", "n", "dims", "products"])

        for key, n, m in parts:
            if key not in held and len(held) >= most:
                yield give()
            have, own = held.get(key, (0, np.zeros((0, 0), np.int64)))
            dims = max(len(own), len(m))
            held[key] = (have + n, grown(own, dims) + grown(m, dims))
        if held:
            yield give()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(batches):
            for batch in batches:
                names = batch.column(0).dictionary_encode(null_encoding="encode")
                of, vectors = names.indices.to_numpy(), batch.column(1)
                size = vectors.value_lengths().to_numpy()
                at = np.concatenate([[0], np.cumsum(size)])
                flat = vectors.flatten().to_numpy()
                for i, key in enumerate(names.dictionary.to_pylist()):
                    own = np.flatnonzero(of == i)
                    m = np.zeros((len(own), size[own].max(initial=0)), np.int64)
                    for r, p in enumerate(own.tolist()):
                        m[r, : size[p]] = flat[at[p] : at[p + 1]]
                    yield key, len(own), m.T @ m

        first = next(batches, None)
        if first is not None:
            yield from summed(parts(itertools.chain([first], batches)), first.column(0).type)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            rows = (row for b in itertools.chain([first], batches) for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
            yield from summed(((k, n, np.array(p, np.int64).reshape(d, d)) for k, n, d, p in rows), first.column(0).type)

    schema = StructType([rows.schema["g"], *StructType.fromDDL("n long, dims int, products array<long>").fields])
    merged = rows.mapInArrow(partial, schema).repartition("g").sortWithinPartitions("g").mapInArrow(merge, schema)
    return merged.withColumnRenamed("g", by)


class _Page(HTMLParser):
    SILENT = {"script", "style", "noscript", "template"}
    BREAKS = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "nav", "footer", "header", "table", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.parts, self.silent, self.in_title = [], 0, [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and any(k == "href" for k, _ in attrs):
            self.links += 1
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.parts.append(data)


def html_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` with title, links (anchors with an address) and body (lines of visible text, blanks joined); null html gives an empty title and body."""
    names = [c for c in pages.columns if c not in ("title", "links", "body")]
    at = names.index(column)
    rows = pages.select(*names)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "title string, links long, body string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html in batch.column(at).to_pylist():
                page = _Page()
                page.feed(html or "")
                page.close()
                lines = (" ".join(x.split()) for x in "".join(page.parts).split("\n"))
                found.append((" ".join("".join(page.title).split()), page.links, "\n".join(filter(None, lines))))
            cols = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)]], [*names, "title", "links", "body"])

    return rows.mapInArrow(run, schema)
