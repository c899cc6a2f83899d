"""SentencePiece texts, vector codes and the filter audit, against the library and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from conftest import SF

from quarrystone.llm import audit as A
from quarrystone.llm import codes as C
from quarrystone.llm.entry import QUERIES
from quarrystone.llm.pieces import Segmenter, decode_ids, encode_texts, public_model


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_model())


ODD_TEXTS = [
    None, "", " ", "  ", " " * 40, "a", " a", "a ", "  a  b ", "a▁b", "▁", "▁ ▁x", "tab\tand\nline\r\nend", "a　b c", "\x00x\x00 y", "é ﬁ ① 漢字かな 한국어 עברית",
    "\U0001f600\U0001f600 \U0001f468‍\U0001f469", "<s> </s> <unk> <0x41>", "[INST] x [/INST]", "x" * 5000, "ab" * 3000 + " c", "word " * 3000, "1234567890" * 30, "á é", "� ퟿ \U0010ffff",
]


def test_pieces_equal_the_library(spark, library):
    rng = random.Random(3)
    alphabet = ["a", "e", "th", "the", "ing", " ", " ", "  ", "\n", "\t", "▁", ".", ",", "é", "漢", "\U0001f600", "0", "7", "Z", "\x01", "<s>", "\r"]
    texts = ODD_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decode_ids(encode_texts(df)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        assert got[i].ids == ids, text
        assert got[i].decoded == library.decode(ids), text


def test_pieces_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_sentence_pieces"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_pieces_table_is_exact_and_bounded(library):
    one = Segmenter(public_model(), table_bytes=20_000, longest=12)
    assert one.separable
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)] + ["longer-than-twelve-letters " * 5]
    for text in texts * 2:
        assert one.encode(text).tolist() == library.encode(text)
        assert one.held <= 20_000 + 50 * 400
    assert max(map(len, one.table)) <= 12
    one.separable = False
    assert one.encode(texts[0]).tolist() == library.encode(texts[0])


def test_pieces_awkward_rows(spark, library):
    df = spark.createDataFrame([(1, "a b", {"k": 1}, "x"), (None, None, None, None), (1, "a b", {"k": 1}, "x"), (2, "", {}, "y")], "doc_id long, TEXT string, extra map<string,int>, ids string")
    out = decode_ids(encode_texts(df), text="extra")
    assert out.columns == ["doc_id", "ids", "extra"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, [264, 287], "a b"), (1, [264, 287], "a b"), (2, [], ""), (None, [], "")], key=str)
    assert encode_texts(df.limit(0)).collect() == [] and encode_texts(df).columns == ["doc_id", "extra", "ids"]
    odd = spark.sql("SELECT 1 AS doc_id, cast(X'61ff62' AS string) AS text")
    assert encode_texts(odd).first().ids == library.encode("a�b")
    lists = spark.sql("SELECT * FROM VALUES (1, array(264, null, 287)), (2, null), (3, array()) AS t(doc_id, ids)")
    assert [r.decoded for r in decode_ids(lists).orderBy("doc_id").collect()] == ["a b", "", ""]
    with pytest.raises(ValueError, match="named text"):
        encode_texts(df.drop("TEXT"))
    with pytest.raises(ValueError, match="share a name"):
        encode_texts(df.selectExpr("TEXT", "doc_id", "doc_id AS Doc_ID"))


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """(code, error) by row, and the codebooks, with Python's own integers."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(r[1]) for _, r in kept), default=0)
    size = -(-longest // parts)
    x = {i: [math.floor(1024 * v) for v in r[1]] + [0] * (parts * size - len(r[1])) for i, r in kept}
    own = lambda i, p: x[i][p * size : (p + 1) * size]
    smallest = sorted(x, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [math.floor(1024 * v) for v in rows[i][1]]))[:entries]
    books = [[own(i, p) for i in smallest] for p in range(parts)]
    near = lambda i, p: min((sum((a - b) ** 2 for a, b in zip(own(i, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for i in x:
                of.setdefault(near(i, p)[1], []).append(own(i, p))
            for e, members in of.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = {i: [near(i, p) for p in range(parts)] for i in x}
    return [(rows[i][0], rows[i][2], "".join(f"{e:02x}" for _, e in found[i]), sum(d for d, _ in found[i])) for i in x], books


VECTORS = "vec_id long, embedding array<double>, label string"


@pytest.mark.parametrize("block", [4096, 5])
def test_codes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    vector = lambda n=8: [rng.choice([rng.uniform(-1, 1), rng.choice([-0.5, 0.0, 0.25])]) for _ in range(n)]
    rows = [(i, vector(), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(70 + i, rows[3][1], "a") for i in range(30)] + [(5, vector(), "b"), rows[7], rows[7], (None, vector(), None), (None, vector(), "c")]
    rows += [(200, None, "a"), (201, [None] * 8, "a"), (202, [float("nan")] * 8, "a"), (203, [float("inf")] + [0.0] * 7, "b"), (204, vector(5), "d"), (205, [], "d"), (-3, vector(3), None)]
    for entries in (256, 7):
        got, books = C.compress_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries)
        expected, entries_expected = brute_codes(rows, entries=entries)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
        assert books.entries.tolist() == entries_expected
        assert books.digest() == hashlib.sha256(",".join(str(c) for p in entries_expected for e in p for c in e).encode()).hexdigest()


def test_codes_awkward_tables(spark):
    empty, books = C.compress_vectors(spark.createDataFrame([(1, None, "x")], VECTORS))
    assert empty.collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()
    none, _ = C.compress_vectors(spark.createDataFrame([(1, [], "x"), (2, [], None)], VECTORS))
    assert sorted(map(tuple, none.collect())) == [(1, "x", "00000000", 0), (2, None, "00000000", 0)]
    extra = spark.createDataFrame([(1, [0.5, 0.25], "x", 1, "y")], "VEC_ID long, embedding array<double>, Label string, `values` int, code string")
    got, _ = C.compress_vectors(extra)
    assert got.columns == ["vec_id", "label", "code", "error"] and got.first().code == "00000000"
    with pytest.raises(ValueError, match="64 bits"):
        C.compress_vectors(spark.createDataFrame([(1, [1e300, 0.0], "x")], VECTORS))
    with pytest.raises(ValueError, match="two hex digits"):
        C.compress_vectors(extra, entries=257)


def test_nearest_of_narrow_and_wide_numbers():
    rng = np.random.default_rng(1)
    for reach in (10, 5000, 2**24):
        x, c = rng.integers(-reach, reach, (5, 1300)), rng.integers(-reach, reach, (40, 5))
        c[7] = c[3]
        index, error = C.nearest(x, c)
        all_pairs = ((x.T[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (index == all_pairs.argmin(axis=1)).all() and (error == all_pairs.min(axis=1)).all() and 7 not in index


def brute_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    found = []
    for doc_id, text, lang in docs:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs),
        }
        mark = lambda k, d=doc_id: any(d is not None and r[0] == d and r[k] == 1 for r in labels)
        found.append((lang or "", fails, mark(1), mark(2)))
    out = []
    for part in {x[0] for x in found}:
        own = [x for x in found if x[0] == part]
        removed, rows = {}, []
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone, rest = [x for x in left if x[1][name]], [x for x in left if not x[1][name]]
                removed[name] = removed.get(name, 0) + len(gone)
                fails = sum(x[1][name] for x in own)
                only = sum(x[1][name] and sum(x[1].values()) == 1 for x in own)
                rows.append((part, "".join(order), step, len(rest), len(gone), fails - len(gone), only, sum(x[2] for x in gone), sum(x[3] for x in gone), name))
                left = rest
        out += [(*r[:-1], removed[r[-1]]) for r in rows]
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 50)
    monkeypatch.setattr(A, "HELD_PARTS", 3)
    monkeypatch.setattr(A, "ROWS", 40)
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "The", "é", "A1", "漢字", f"w{rng.randint(0, 400)}", f"w{rng.randint(0, 400)}"])
    text = lambda: "".join(word() + rng.choice([" ", " ", "\t", "\n", "  ", "\x0b", " "]) for _ in range(rng.choice([0, 3, 190, 250]))) + rng.choice(["", "", " 5%", "#"])
    docs = [(i, text(), rng.choice(["en", "de", None, "", "x", "y"])) for i in range(150)]
    docs += [(1000 + i, docs[3][1], "en") for i in range(60)] + [(2000 + i, None, "de") for i in range(5)] + [(-1, "", None), (None, docs[3][1], "en"), (3, docs[3][1], "en"), (5, docs[6][1], "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (1001, 1, 0), (99_999, 1, 1)]
    got = A.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(docs, labels))


def test_audit_awkward_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.audit(docs, labels).collect() == []
    clash = spark.createDataFrame([(1, "x", "en", 1, "p"), (2, None, None, 2, "q")], "DOC_ID long, Text string, lang string, digest int, part string")
    got = A.audit(clash, labels).collect()
    assert len(got) == 2 * 600 and {r.part for r in got} == {"", "en"} and all(r.removed == (r.filter_order[r.step - 1] == "A") or r.part == "en" for r in got)
    assert A.own_failures(b"") == 1 and A.own_failures(b"x" * 3_000_000) == 1
    assert b"".join(A.pieces(b"ab cd " * 500_000)) == b"ab cd " * 500_000


def test_first_failures_table():
    table = A.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b00010, A.ORDERS.index("ABCDE")] == 1 and table[0b10100, A.ORDERS.index("DEACB")] == 1
