"""Near-duplicate documents by bottom-k sketches of word shingles.

Method. One hash function orders a document's shingles; its sketch is the k smallest. Documents with
equal sets become one node. Nodes of whose retained values too few are held by any other drop out at
once; the rest get a wider sketch. Inverted lists of its retained values generate overlaps: a similar pair
shares at least a certain number of them (see `least_common` and `_index`), so it suffices to
index each node's rarest (prefix filtering), and passages that many documents share rarely make a list.
The union sketch estimates a pair's similarity and filters; the full sets decide.

Groups of any size. No list is expanded into all its pairs at first: each round compares the members of
a list with two centres, merges what proved similar, and drops the lists whose members are all in one
component. When the pairs left between components are few for the size of the index, or after
`star_rounds`, the rest is settled: members compared with the same centre by inverted lists over their differences
from it (see `_links_by_differences`), others by the lists' pairs, so no link between different components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm import text as T
from quarrystone.llm.components import connected_components
from quarrystone.llm.work import Work


def least_common(k: int, percent: int, miss: float = 1e-7) -> int:
    """The largest c such that two sets of that similarity show fewer than c common values among the k smallest of their union with a chance below `miss`."""
    p, below, c = percent / 100, 0.0, 0
    while (below := below + math.comb(k, c) * p**c * (1 - p) ** (k - c)) < miss:
        c += 1
    return max(1, c)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, data, offsets in T.chunks(batch):
        h, first = T.shingles(T.Words(data, offsets), shingle)
        h = h.view(np.int64)
        yield rows, [np.unique(h[first[i] : first[i + 1]]) for i in range(len(offsets) - 1)]


def _flat(parts: list[np.ndarray]) -> pa.ListArray:
    return T.lists(np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32))


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """(doc_id, own, n, digest, sketch) for each row: a hash of the text, the set's size, a 128-bit digest of it (null if empty) and its k smallest hashes."""

    def run(batches):
        for batch in batches:
            for rows, sets in _sets(batch, shingle):
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                        _flat([x[:k] for x in sets]),
                    ],
                    ["doc_id", "own", "n", "digest", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("own"), "text")
    return rows.mapInArrow(T.trimmed(run), "doc_id long, own long, n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) for each row of `docs` (node, text), for exact comparison."""

    def run(batches):
        for batch in batches:
            for rows, sets in _sets(batch, shingle):
                yield pa.RecordBatch.from_arrays([rows.column(0), _flat(sets)], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(T.trimmed(run), "node long, shingles array<long>")


def _floor(n: Column, k: int, percent: int) -> Column:
    """Retained values, of k at most, that a set of size n shares with any similar one."""
    # A set that its sketch holds whole: its partner is whole too, or at most n / t large.
    whole = F.least(F.ceil(n * percent / 100), F.ceil(k - n * (100 / percent - 1)))
    return F.greatest(F.lit(1), F.when(n > k, least_common(k, percent) if k < 1 << 31 else 1).otherwise(whole))


def _screened(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The nodes of which enough retained values are held by any other."""
    posts = nodes.select("node", "n", F.explode("sketch").alias("v"))
    shared = posts.groupBy("v").agg(F.count("*").alias("df")).where("df >= 2").select("v")
    return posts.join(shared, "v").groupBy("node", "n").agg(F.count("*").alias("held")).where(F.col("held") >= _floor(F.col("n"), k, percent)).select("node").distinct()


def _index(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, node, n, low, high): inverted lists of each node's rarest retained values, as many as a similar node can't all avoid.

    The p-th rarest value is of use only for partners so large or small that the overlap they need leaves
    the p values before it out: partners of at most `low` or at least `high` shingles. That is exact where both sets
    are held whole; between larger sets it holds for the expected overlap less 5.5 standard deviations; between
    one of each, values are of use for all sizes.
    """
    t = percent / (100 + percent)  # of both sizes' sum, what similar sets have in common
    posts = sets.select("node", F.size("shingles").alias("n"), F.explode(F.slice("shingles", 1, min(k, (1 << 31) - 1))).alias("v"))
    shared = posts.groupBy("v").agg(F.count("*").alias("df")).where("df >= 2")
    held = posts.join(shared, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    n, size = F.col("n"), F.least(F.col("n"), F.lit(k))
    # Values that no other node holds come first in the order.
    alone = size - F.size("held")
    left = (size - _floor(n, k, percent) + 1 - alone).cast("int")
    p = F.col("alone") + F.col("pos")
    q = (k - p + 2.2 * math.sqrt(k) + 1) / k / t - 1
    everything = F.lit(1 << 60)
    low = F.when(n <= k, F.floor((n - p) / t + 1e-9) - n).when(q < 1, F.floor(q * n + 1)).otherwise(everything)
    high = F.when((n > k) & (q < 1) & (q > 0), F.floor(n / q)).otherwise(everything)
    index = held.select("node", "n", "held", alone.alias("alone"), left.alias("left")).where("left >= 1")
    return index.select("node", "n", "alone", F.posexplode(F.slice("held", F.lit(1), F.col("left"))).alias("pos", "x")).select("x.v", "node", "n", low.cast("long").alias("low"), high.cast("long").alias("high"))


def _useful(index: DataFrame, k: int) -> DataFrame:
    """`index` without the postings that no other of their list can use."""
    lists = index.groupBy("v").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).where("c >= 2")
    keep = f"least <= low or most >= high or (n <= {k} and most > {k}) or (n > {k} and least <= {k})"
    return index.join(lists, "v").where(keep).select("v", "node", "n", "low", "high")


def _compared(pairs: DataFrame, nodes: DataFrame | None, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, similar) of the pairs that the union sketch of `nodes` leaves (all, without them); the full sets decide."""
    floor = least_common(k, percent)
    side = lambda df, name, col: df.select(F.col("node").alias(name), F.col(col).alias(f"{col}_{name}"))
    near = pairs
    if nodes is not None:
        near = pairs.join(side(nodes, "a", "sketch"), "a").join(side(nodes, "b", "sketch"), "b")
        both = F.array_intersect("sketch_a", "sketch_b")
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
        seen = F.size(F.array_intersect(union, both))
        # Below k values the union sketch is the union, and the estimate is exact.
        near = near.where(F.when(F.size(union) < k, 100 * seen >= percent * F.size(union)).otherwise(seen >= floor)).select("a", "b")
    full = near.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return full.select("a", "b", (100 * common >= percent * (F.size("shingles_a") + F.size("shingles_b") - common)).alias("similar"))


def _references(own: DataFrame, tested: DataFrame, most: int) -> DataFrame:
    """(node, n, label, refs): the nodes of the open lists, each with up to `most` of the nodes it was compared with, those that most of them were compared with."""
    nodes = own.select("node", "n", "label").distinct()
    both = tested.select(F.col("a").alias("node"), F.col("b").alias("ref")).union(tested.select(F.col("b").alias("node"), F.col("a").alias("ref")))
    both = both.distinct().join(nodes.select("node"), "node", "left_semi")
    common = both.groupBy("ref").agg(F.count("*").alias("c"))
    order = Window.partitionBy("node").orderBy(F.desc("c"), "ref")
    best = both.join(common, "ref").withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).groupBy("node").agg(F.collect_list("ref").alias("refs"))
    return nodes.join(best, "node", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<long>")))


def _links_by_differences(refs: DataFrame, sets: DataFrame, percent: int, work: Work, name: str) -> DataFrame:
    """(a, b): the similar pairs of different labels among nodes of one reference c, which all of them were compared with.

    With D(x) for what the sets of x and c do not have in common, sets x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| members
    and are similar if that is at most g = (100 - percent) / (100 + percent) of both sizes' sum: if
    |D(x) & D(y)| >= (A(x) + A(y)) / 2 with A(x) = |D(x)| - g n(x). As links with c are known, that is above 0 for
    labels that differ, so inverted lists over the differences find every pair. They are far sparser than those over the
    sets: near-copies of one text share its shingles, but seldom their changes. A value that p rarer ones of D(x) come before
    is of use only for partners of A(y) <= 2 (|D(x)| - p) - A(x).
    """
    refs = refs.select("node", "n", "label", F.explode("refs").alias("ref"))
    mixed = refs.groupBy("ref").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("ref")
    side = lambda name, col: sets.select(F.col("node").alias(name), F.col("shingles").alias(col))
    diff = refs.join(mixed, "ref", "left_semi").join(side("node", "x"), "node").join(side("ref", "c"), "ref")
    diff = diff.select("ref", "node", "label", "n", F.array_union(F.array_except("x", "c"), F.array_except("c", "x")).alias("d"))
    g = (100 - percent) / (100 + percent)
    diff = work.put(diff.select("*", (F.size("d") - F.col("n") * g).alias("a")), f"{name}-differences")
    # Values that differ for nodes of one label only are common to no pair; they come first in the order.
    values = diff.select("ref", "label", "node", F.explode("d").alias("v"))
    shared = values.groupBy("ref", "v").agg(F.count("*").alias("df"), F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("ref", "v", "df")
    held = values.join(shared, ["ref", "v"]).groupBy("ref", "node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    least = diff.groupBy("ref").agg(F.min("a").alias("least"))
    p = F.col("p") + F.size("d") - F.size("held")
    lists = diff.join(held, ["ref", "node"]).join(least, "ref").select("*", F.posexplode("held").alias("p", "h"))
    lists = lists.select("ref", "h.v", "node", "label", "a", (2 * (F.size("d") - p) - F.col("a")).alias("most"), "least")
    lists = work.put(lists.where("least <= most + 1e-6").drop("least"), f"{name}-lists")
    other = lists.select("ref", "v", *[F.col(x).alias(f"{x}_b") for x in ("node", "label", "a", "most")])
    found = lists.join(other, ["ref", "v"]).where("node < node_b and label <> label_b and a <= most_b + 1e-6 and a_b <= most + 1e-6")
    found = work.put(found.groupBy("node", "node_b").agg(F.min(F.struct("ref", "a", "a_b")).alias("by")).select("node", "node_b", "by.*"), f"{name}-pairs")
    own = lambda x: held.select("ref", F.col("node").alias(x), F.transform("held", lambda h: h["v"]).alias(f"held_{x}"))
    found = found.join(own("node"), ["ref", "node"]).join(own("node_b"), ["ref", "node_b"])
    alike = F.size(F.array_intersect("held_node", "held_node_b"))
    return found.where(2 * alike + 1e-6 >= F.col("a") + F.col("a_b")).select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 32, wide: int = 512, star_rounds: int = 2, pairs_per_posting: int = 4, most_references: int = 1, exact: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A document's set holds its
    distinct runs of `shingle` words; with fewer words the whole sequence is the one member. Documents
    are linked when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable;
    kept tells whether it is the row's own.

    Null or blank texts have no shingles and no links of their own. Rows that share a doc_id are one document: a link of
    any holds for all, whatever their texts. A null doc_id has a null component_id, links nothing, and is kept. An empty
    table gives an empty result. Sets are of 64-bit hashes of shingles.

    With `exact`, nothing rests on chances: no node is screened out by its sketch, the index holds whole sets whatever their size, and the full sets alone decide on
    pairs. That indexes every shingle that two documents share, so it costs more where texts are long.
    """
    wide = 1 << 40 if exact else wide
    spark = docs.sparkSession
    work = Work(spark, "near-duplicates")
    sk = work.put(sketches(docs, shingle, k), "sketches")
    # A node is a class of equal sets. Its number says nothing of doc_ids, which can repeat with other texts.
    classes = sk.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "own")).alias("of"))
    classes = work.put(classes.select("digest", "of.doc_id", "of.own", F.monotonically_increasing_id().alias("node")), "classes")
    nodes = sk.where("digest is not null").select("doc_id", "own", "n", "sketch").join(classes.drop("digest"), ["doc_id", "own"]).select("node", "n", "sketch").dropDuplicates(["node"])
    members = work.put(nodes.select("node") if exact else _screened(nodes, k, percent), "members")
    nodes = work.put(nodes.join(members, "node", "left_semi"), "nodes")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("own"), "text")
    rows = rows.join(classes.join(members, "node", "left_semi").select("doc_id", "own", "node"), ["doc_id", "own"]).select("node", "text").distinct()
    sets = work.put(full_sets(rows, shingle), "sets")
    index = work.put(_index(sets, wide, percent), "index")
    index = work.put(_useful(_useful(index, wide), wide), "lists")
    work.drop("index", "members")
    index_size = index.count()
    usable = f"(n <= {wide}) <> (n_b <= {wide}) or ((n_b <= low or n_b >= high) and (n <= low_b or n >= high_b))"
    links, tested, graph, last = _shared_ids(sk, classes, work), None, None, False
    if links is not None:
        graph = work.put(connected_components(links, work, "graph"), "labels")
    for i in range(star_rounds + 1):
        own = index.withColumn("label", F.col("node")) if graph is None else index.join(graph, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        keys = [F.xxhash64("node", F.lit(2 * i + j)) if i + j else F.col("node") for j in range(2)]  # other centres each round
        best = [x for j, k in enumerate(keys) for x in (F.min(k).alias(f"key{j}"), F.min_by("node", k).alias(f"centre{j}"))]
        parts = own.groupBy("v", "label").agg(F.count("*").alias("c"), *best)
        centres = F.array_distinct(F.array(*[F.min_by(f"centre{j}", f"key{j}") for j in range(2)])).alias("centres")
        lists = parts.groupBy("v").agg(F.sum("c").alias("c"), F.count("*").alias("labels"), F.sum(F.expr("cast(c as double) * c")).alias("within"), centres)
        lists = work.put(lists.where("labels > 1").select("v", "centres", F.expr("(cast(c as double) * c - within) / 2").alias("across")), f"open-{i}")
        across = lists.agg(F.sum("across")).first()[0]
        if across is None:
            break
        last = last or i == star_rounds or (i > 0 and across <= pairs_per_posting * index_size)
        # As a table of its own, a list that holds a third of all nodes can be split by the joins below.
        own = own.join(lists.select("v", "centres"), "v")
        made = [f"pairs-{i}", f"open-{i}", f"own-{i}"]
        more = None
        if last and tested is not None:
            own = work.put(own, f"own-{i}")
            refs = work.put(_references(own, tested, most_references), f"refs-{i}")
            more = _links_by_differences(refs, sets, percent, work, f"last-{i}")
            own = work.put(own.join(refs.select("node", "refs"), "node"), f"referred-{i}")
            made += [f"refs-{i}", f"referred-{i}", *[f"last-{i}-{x}" for x in ("differences", "lists", "pairs")]]
        else:
            own = work.put(own.withColumn("refs", F.lit(None).cast("array<long>")), f"own-{i}")
        other = own.select("v", *[F.col(x).alias(f"{x}_b") for x in ("node", "n", "label", "low", "high", "refs")], F.col("centres").alias("of"))
        if last:
            found = own.join(other, "v").where("node < node_b and not coalesce(arrays_overlap(refs, refs_b), false)")
        else:
            found = own.join(other.where("array_contains(of, node_b)"), "v").where("node <> node_b")
        found = found.where(f"label <> label_b and 100 * least(n, n_b) >= {percent} * greatest(n, n_b)").where(usable)
        found = work.put(found.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct(), f"pairs-{i}")
        compared = work.put(_compared(found, None if exact else nodes, sets, k, percent), f"compared-{i}")
        tested = compared if tested is None else tested.union(compared)
        new = compared.where("similar").select("a", "b")
        new = work.put(new if more is None else new.union(more), f"links-{i}")
        work.drop(*made)
        if new.limit(1).count():
            links = new if graph is None else new.union(graph.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
            graph = work.put(connected_components(links, work, f"graph-{i}"), f"labels-{i}")
        elif not last:
            last = True  # centres find no more: the rest is tested pair by pair
            continue
        if last:
            break
    found = classes.select("digest", "doc_id", "node")
    if graph is not None:
        found = found.join(graph, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = found.groupBy("component").agg(F.min("doc_id").alias("least"))
        found = work.put(found.join(least, "component").select("digest", "least"), "found")
    else:
        found = found.select("digest", F.col("doc_id").alias("least"))
    work.drop("lists", "sets", "nodes")
    out = sk.select("doc_id", "n", "digest").join(found, "digest", "left")
    blank = sk.where("digest is null and doc_id is not null").select("doc_id").distinct()
    if blank.limit(1).count():  # a row without words goes with the others of its doc_id
        beside = sk.where("digest is not null").select("doc_id", "digest").join(blank, "doc_id", "left_semi").join(found, "digest").groupBy("doc_id").agg(F.min("least").alias("beside"))
        out = out.join(work.put(beside, "beside"), "doc_id", "left").withColumn("least", F.coalesce("least", "beside"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _shared_ids(sk: DataFrame, classes: DataFrame, work: Work) -> DataFrame | None:
    """(a, b): links of nodes that have a doc_id in common, a star for each; None if there are none."""
    rows = sk.where("digest is not null and doc_id is not null")
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("l"), F.max("digest").alias("m")).where("l <> m").select("doc_id", "l")
    several = work.put(several, "several")
    if not several.limit(1).count():
        return None
    links = rows.select("doc_id", "digest").join(several, "doc_id").select("digest", "l").distinct()
    number = lambda key, name: classes.select(F.col("digest").alias(key), F.col("node").alias(name))
    return work.put(links.join(number("digest", "a"), "digest").join(number("l", "b"), "l").select("a", "b"), "shared")
