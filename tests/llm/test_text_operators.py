"""Near-duplicates, decontamination, toxicity and packing against brute force and on awkward rows."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarrystone.llm import text as T
from quarrystone.llm.components import connected_components
from quarrystone.llm.decontamination import MASKS, contaminated
from quarrystone.llm.near_duplicates import near_duplicates
from quarrystone.llm.packing import best_fit, pack_documents, public_tokenizer
from quarrystone.llm.tokens import Encoder
from quarrystone.llm.toxicity import ToxicityModel
from quarrystone.llm.work import Work

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def classes(docs, k, percent=80):
    """{doc_id: smallest doc_id reachable} by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def copies(seed, groups=6, members=14, words=60, edits=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)] + passage * (rng.random() < 0.5)
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out, 1))


def families(seed, members):
    """Copies of copies, copies with spans cut out or common passages put in, and mixes of common passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages, out = [draw(40) for _ in range(8)], []
    for size in (50, 120):
        base = draw(size)
        family = [base]
        for _ in range(members):
            family.append([rng.choice(vocabulary) if rng.random() < 0.012 else w for w in rng.choice(family)])
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                a = rng.randrange(len(own))
                del own[a : a + rng.randint(1, len(own) // 12 + 1)]
            if rng.random() < 0.3:
                own[5:5] = rng.choice(passages)[: rng.randint(3, 12)]
            out += [own, sum(rng.sample(passages, 3), []) + draw(rng.randint(0, 9))]
        out += family
    rng.shuffle(out)
    return list(enumerate((" ".join(x) for x in out), 1))


@pytest.mark.parametrize("settings", [{}, {"exact": True, "k": 4, "wide": 8}, {"pairs_per_posting": 0, "most_references": 2}, {"star_rounds": 0}, {"star_rounds": 6, "pairs_per_posting": 0, "wide": 40}])
def test_near_duplicates_of_families_equal_all_pairs(spark, settings):
    docs = families(7, 50)
    want, sizes = classes(docs, 4)
    got = near_duplicates(spark.createDataFrame(docs, DOCS), shingle=4, **settings).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert 2 < len(set(want.values())) < len(want)


def test_near_duplicates_of_repeated_doc_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b), (7, b), (12, c), (12, None), (11, c + " z"), (5, None), (5, ""), (20, b + " z"), (7, "")]
    got = near_duplicates(spark.createDataFrame(rows, DOCS), shingle=4).collect()
    want = {3: 3, 7: 3, 9: 3, 20: 3, 12: 11, 11: 11, 5: 5}
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((i, want[i], want[i] == i) for i, _ in rows)


@pytest.mark.parametrize("settings", [{}, {"k": 8, "wide": 16, "star_rounds": 1}, {"pairs_per_posting": 0}])
def test_near_duplicates_equal_all_pairs(spark, settings):
    docs = copies(3)
    want, sizes = classes(docs, 4)
    got = near_duplicates(spark.createDataFrame(docs, DOCS), shingle=4, **settings).collect()
    assert len(got) == len(docs)
    if settings.get("k", 32) >= 32:
        assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = near_duplicates(spark.createDataFrame(docs, DOCS), shingle=5).collect()
    assert {r.doc_id: r.component_id for r in got} == classes(docs, 5)[0]


def test_near_duplicates_awkward_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (4, "One two", "d"), (5, "one TWO", "e"), (6, long, "f"), (7, long + " y", "g"), (7, long + " y", "g"), (None, "one two", "h"), (9, "é Ü", "i"), (10, "é ü", "j")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node string"), shingle=4).collect()
    by = sorted(((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None))
    assert by == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (7, 6, False), (9, 9, True), (10, 10, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(5, 5), (200, 199)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long"), Work(spark, "test")).collect())
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 60)} | {199: 199, 200: 199}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Work(spark, "test")).collect() == []


def test_masks_hit_two_replaced_tokens_in_thirteen():
    for gone in itertools.combinations(range(13), 2):
        assert any(not {o + x for x in m} & set(gone) for m in MASKS for o in range(13 - m[-1]))


def brute_overlaps(docs, items):
    """Every place of every item against every place of every document."""
    numbers: dict[str, int] = {}
    tokens = lambda s: np.array([numbers.setdefault(w.decode(), len(numbers)) for w in re.findall(rb"[0-9a-zA-Z\x80-\xff]+", (s or "").translate(LOWER).encode())], np.int32)
    docs, items = [(d, tokens(t)) for d, t in docs], [(i, tokens(t)) for i, t in items]
    found = set()
    for (d, a), (i, b) in itertools.product(docs, items):
        size = min(13, len(b))
        need = 11 if len(b) >= 13 else len(b)
        places, starts = len(a) - size + 1, len(b) - size + 1
        if len(b) < 8 or places < 1:
            continue
        equal = (a[:, None] == b[None]).astype(np.int8)
        if (sum(equal[k : k + places, k : k + starts] for k in range(size)) >= need).any():
            found.add((d, i))
    return found


@pytest.mark.parametrize("block", [500_000, 60])
def test_contaminated_equals_brute_force(spark, block):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(60)]
    item = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, item(rng.choice([5, 8, 10, 13, 20, 40]))) for i in range(20)]
    docs = []
    for d in range(80):
        body = item(30)
        own = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = "changed"
        at = rng.randint(0, 30)
        docs.append((d, ", ".join(body[:at] + own[rng.randint(0, 3) :] + body[at:]).upper()))
    items = [(i, " ".join(x)) for i, x in items]
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_tokens=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_overlaps(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


@pytest.mark.parametrize("block", [500_000, 60])
def test_contaminated_by_short_items(spark, block):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(300)]
    item = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(n, item(n)) for n in range(1, 15)] + [(20, []), (21, ["t1", "t1"])]
    docs = [(1000, ""), (1001, None), (1002, "t1 t1 t1")]
    for n, own in items[:14]:
        for gone in itertools.chain([()], itertools.combinations(range(n), 1), itertools.combinations(range(n), 2)):
            text = [w if i not in gone else "changed" for i, w in enumerate(own)]
            docs.append((len(docs), ", ".join(item(rng.randint(0, 3)) + text + item(rng.randint(0, 3))).upper()))
    docs += [(2000, " ".join(items[9][1][:9])), (2001, " ".join(items[9][1][1:]))]
    want = set()
    for (d, text), (i, own) in itertools.product(docs, items):
        a, size = (text or "").lower().replace(",", "").split(), min(13, len(own))
        need = size - (0 if size < 8 else 1 if size < 13 else 2)
        if size and any(sum(x == y for x, y in zip(a[p : p + size], own[q : q + size], strict=True)) >= need for q in range(len(own) - size + 1) for p in range(len(a) - size + 1)):
            want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = contaminated(spark.createDataFrame(docs, DOCS), bench, block_tokens=block, short=True).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    assert {i for _, i in want} == {*range(1, 15), 21}


def test_contaminated_by_repetitive_texts(spark):
    """Texts and items of one or two words over and over: every alignment hits."""
    import time

    rng = random.Random(3)
    items = [(i, ["ha"] * 40) for i in range(30)] + [(40 + i, ["ha", "ho"] * 20) for i in range(10)] + [(60, ["ha"] * 30 + ["x"] + ["ha"] * 9), (61, ["no"] * 13), (62, ["ha"] * 9)]
    docs = [(1, ["ha"] * 300), (2, ["ho", "ha"] * 150), (3, ["ha"] * 11), (4, [rng.choice(["ha", "ha", "ha", "ho"]) for _ in range(300)]), (5, ["ha"] * 20 + ["x"] + ["ha"] * 200), (6, ["y"] * 300)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = contaminated(spark.createDataFrame([(i, " ".join(x)) for i, x in docs], DOCS).coalesce(1), bench, short=True).collect()
    want = {}
    for (d, a), (i, b) in itertools.product(docs, items):
        size = min(13, len(b))
        need = 11 if size == 13 else size - 1
        for begin in range(-len(b) + 1, len(a)):
            same = [0 <= begin + k < len(a) and a[begin + k] == b[k] for k in range(len(b))]
            windows = [k for k in range(len(b) - size + 1) if begin + k >= 0 and begin + k + size <= len(a) and sum(same[k : k + size]) >= need]
            if windows:
                x = (max(sum(same[k : k + size]) for k in windows), sum(same), -(begin + windows[0]))
                want[d, i] = max(want.get((d, i), x), x)
    places = {d: {m.start(): k for k, m in enumerate(re.finditer(r"[a-z]+", " ".join(a)))} for d, a in docs}
    assert {(r.doc_id, r.item_id): (r.best_window, r.equal_tokens, -places[r.doc_id][r.start]) for r in got} == want
    long = spark.createDataFrame([(1, "ha " * 32_000), (2, "ha ho " * 16_000)], DOCS)
    began = time.time()
    assert contaminated(long, bench, short=True).count() == 32 + 10
    assert time.time() - began < 40


def test_contaminated_places_and_awkward_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = [(1, f"Vor ü: {item}."), (2, None), (3, ""), (4, item[: len(item) // 2]), (5, item), (5, item), (6, "x " * 40_000 + item)]
    df = spark.createDataFrame([(*x, 1) for x in docs], DOCS + ", item_id int")
    bench = spark.createDataFrame([(7, item, "q"), (8, None, "q"), (9, "", "q"), (7, item, "r")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in contaminated(df, bench).collect()}
    assert set(got) == {1, 5, 6}
    assert docs[0][1][got[1].start : got[1].end] == item
    assert contaminated(df.limit(0), bench).collect() == []
    assert contaminated(df, bench.limit(0)).collect() == []


def balanced(n):
    """The first n letters of a word of a and b in which each doubled block turns over, and its opposite: weighted sums of their letters agree."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n], word[:n].translate(str.maketrans("ab", "ba"))


def patterned_words():
    rng = random.Random(12)
    out = [w for n in (1, 7, 8, 9, 63, 64, 65, 512, 1024, 2048, 4096, 10_000) for w in balanced(n)]
    for n in (1, 2, 4, 8, 16, 64, 256, 1024):
        a, b = "x" * n, "".join(rng.choice("yz") for _ in range(n))
        out += [a + b, b + a, a + b + a + b, b + a + b + a, a * 3]
    out += ["".join(rng.choice("abé") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    return out + out[::3]


def test_hashes_tell_words_apart():
    words = [w.encode() for w in patterned_words()]
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    found = T.Words(data, offsets, between=np.zeros(256, bool)).hash.tolist()
    assert len(set(found)) == len(set(words)) == len(set(zip(found, words, strict=True)))
    at, of = T.Spans(data).distinct(offsets[:-1], offsets[1:])
    assert [words[at[i]] for i in of] == words and len(at) == len(set(words))


def test_equal_keys_are_compared_by_their_bytes(monkeypatch):
    monkeypatch.setattr(T.Spans, "hash", lambda self, start, end: np.zeros(len(start), np.uint64))
    words = [w.encode() for w in patterned_words()]
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    at, of = T.Spans(data).distinct(offsets[:-1], offsets[1:])
    assert [words[at[i]] for i in of] == words


def test_operators_tell_balanced_words_apart(spark):
    x, y = balanced(1024)
    docs = spark.createDataFrame([(1, x), (2, y)], DOCS).coalesce(1)
    library = Encoder(public_tokenizer()).slow
    got = {r.doc_id: r.ids_crc32 for r in pack_documents(docs, derive={"ids_crc32": F.crc32("ids")}).collect()}
    assert got == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in ((1, x), (2, y))}
    assert [(r.component_id, r.kept) for r in near_duplicates(docs).orderBy("doc_id").collect()] == [(1, True), (2, True)]
    items = spark.createDataFrame([(7, x)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, items, short=True).collect()] == [(1, 7)]


def test_encoder_of_patterned_words():
    encoder = Encoder(public_tokenizer())
    texts = [" ".join(patterned_words()[i : i + 40]) for i in range(0, 300, 40)] + [w for w in patterned_words() if len(w) > 500]
    raw = [t.encode() for t in texts]
    for _ in range(2):
        ids, first = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for d, text in enumerate(texts):
            assert ids[first[d] : first[d + 1]].tolist() == encoder.slow.encode(text, add_special_tokens=False).ids


def test_encoder_cache_stays_within_its_bytes():
    encoder = Encoder(public_tokenizer(), cache_bytes=20_000)
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join(f"q{rng.randrange(10**9)}" for _ in range(200)).encode()
        ids, _ = encoder.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == encoder.slow.encode(text.decode(), add_special_tokens=False).ids
        assert sum(180 + len(k) + len(x) for k, x in encoder.cache.items()) == encoder.held <= 20_000 + 400


def test_encoder_equals_the_library():
    encoder = Encoder(public_tokenizer())
    assert encoder.piece is not None
    rng = random.Random(0)
    parts = [*"ab z'  \n\t.,!sretvlmd1 2éß\u0085\u00a0\x1c—’\u3000", "'s", "'re", " '", "中", "<|endoftext|>", "\r\n", "🙂"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(7)]
        raw = [t.encode() for t in texts]
        ids, first = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for d, text in enumerate(texts):
            assert ids[first[d] : first[d + 1]].tolist() == encoder.slow.encode(text, add_special_tokens=False).ids, text


def test_best_fit_is_gapless():
    rng = np.random.default_rng(1)
    length = rng.integers(1, 1025, 3000)
    bins, offsets, fill = best_fit(length, 1024)
    assert max(fill) <= 1024
    for b in range(len(fill)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == np.concatenate([[0], np.cumsum(length[own])[:-1]]).tolist()
    assert len(fill) <= 1.02 * length.sum() / 1024 + 1


def expected_pieces(docs):
    encoder = Encoder(public_tokenizer()).slow
    out = []
    for d, text in docs:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        n = -(-len(ids) // 1024)
        ends = [len(ids) - (n - 1 - p) * 1024 for p in range(n)]
        for p, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            out.append((d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"block_rows": 20}])
def test_packing(spark, settings):
    from pyspark.sql import functions as F

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1001, None), (1002, ""), (1003, "word " * 30_000), (None, "no id"), (1004, "twice"), (1004, "twice")]
    df = spark.createDataFrame([(*x, 1) for x in docs], DOCS + ", piece int").repartition(3)
    got = pack_documents(df, derive={"crc": F.crc32("ids")}, **settings).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got), key=str) == expected_pieces(docs)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))]
        assert sum(n for _, n in rows) <= 1024
    assert len(by) <= 1.1 * sum(r.length for r in got) / 1024 + 2
    assert pack_documents(df.limit(0)).collect() == []


def test_packing_keeps_ids(spark):
    got = pack_documents(spark.createDataFrame([(1, "hello there")], DOCS), keep_ids=True).collect()
    assert np.frombuffer(got[0].ids, "<u4").tolist() == [*Encoder(public_tokenizer()).slow.encode("hello there").ids, 2]


def test_toxicity_held_out_accuracy_and_spans(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = ToxicityModel.fit(docs, labels)
    held = [r for r in model.score(docs.select("doc_id", "text")).join(labels.select("doc_id", "toxic"), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in held)
    assert right >= 0.98 * len(held)
    caught = [r for r in held if r.toxic and r.score >= 0.5]
    assert len(caught) >= 0.9 * sum(r.toxic for r in held)
    assert sum(r.score >= 0.5 for r in held if not r.toxic) <= 0.005 * len(held)
    for r in caught[:5]:
        for s in r.offending:
            assert r.text[s.start : s.end].strip()


def test_toxicity_scores_are_the_noisy_or_of_sentences(spark):
    """The score, computed word by word from the model's weights."""
    from quarrystone.llm import text as T
    from quarrystone.llm.toxicity import BITS, LEAST_WORDS, PREFIXES

    rng = random.Random(4)
    words = ["good", "house", "scumbag", "idiotic", "trees", "é", "worthless", "and", "x1"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "!", ","]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "..."]

    def number(part, salt):
        w = T.Words(np.frombuffer(part, np.uint8), np.array([0, len(part)]), between=np.zeros(256, bool))
        h = w.hash if salt is None else T.mix(w.hash + np.uint64(salt))
        return int(h[0] >> np.uint64(64 - BITS))

    weights = {}
    for w in words:
        b = w.encode()
        for f in [number(b, None), *[number(b[:n], n) for n in PREFIXES if len(b) > n]]:
            weights.setdefault(f, rng.uniform(-2, 3))
    features = np.array(sorted(weights))
    model = ToxicityModel(-3.0, features, np.array([weights[f] for f in features.tolist()]))

    def expected(text):
        clean, passage = 1.0, []
        parts = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", p) for p in re.split(r"[.!?\n]", text or "")]
        passages = []
        for p in filter(None, parts):
            if passage and len(passage) >= LEAST_WORDS:
                passages.append(passage)
                passage = []
            passage = passage + p
        for own in [*passages, passage]:
            if own:
                found = {f for w in own for f in [number(w.encode(), None), *[number(w.encode()[:n], n) for n in PREFIXES if len(w.encode()) > n]]}
                clean *= 1 - 1 / (1 + np.exp(-(-3.0 + sum(weights[f] for f in found))))
        return 1 - clean

    got = {r.doc_id: r.score for r in model.score(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(expected(text), abs=1e-9), text


def test_toxicity_trains_on_all_of_more_than_4000_labels(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ToxicityModel, "_train", staticmethod(lambda texts, y, *_: seen.append((len(texts), int(y.sum())))))
    df = spark.range(6000).selectExpr("id as doc_id", "concat('word ', id) as text", "cast(id % 5 = 0 as int) as toxic")
    ToxicityModel.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    used = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [(len(used), sum(i % 5 == 0 for i in used))]


def test_toxicity_awkward_rows(spark):
    words = ["fine", "good", "plain", "house", "tree", "green"]
    rng = random.Random(2)
    text = lambda bad: " ".join(rng.choice(words) for _ in range(12)) + (". you scum idiot" if bad else ".")
    rows = [(i, text(i % 3 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = ToxicityModel.fit(spark.createDataFrame(rows, DOCS), labels)
    odd = [(1, None, 1), (2, "", 2), (3, "scum idiot " * 20_000, 3), (None, "green tree", 4), (3, "scum idiot " * 20_000, 3)]
    df = spark.createDataFrame(odd, "doc_id long, text string, score int")
    kept = model.keep(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([odd[0], odd[1], odd[3]], key=str)
    assert [r.score for r in model.score(df.where("doc_id < 3")).collect()] == [0.0, 0.0]
    empty = ToxicityModel.fit(spark.createDataFrame([], DOCS), labels.limit(0))
    assert empty.keep(df).count() == len(odd)
    assert model.score(df.limit(0)).collect() == []


def test_query_results_are_whole(spark):
    from quarrystone.llm.entry import QUERIES

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_sharding", "op3_near_duplicates", "op10_toxicity"):
        assert QUERIES[name](spark, SF).count() == n
