from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from linkspan.llm import simhash
from linkspan.llm.components import connected


def plain_print(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints: dict, radius=3):
    """Smallest key reachable, by comparing all pairs."""
    low = {k: k for k in prints}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius and root(a) != root(b):
                low[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in prints}


def test_fingerprints_and_components(spark):
    r = random.Random(3)
    some = lambda n: " ".join(r.choice(["Anna", "ÉTÉ", "été", "cat", " dog", "x1", "of", "the"]) for _ in range(n))
    texts = [some(r.choice([0, 1, 2, 3, 4, 50, 300])) for _ in range(60)]
    for t in list(texts):
        w = t.split(" ")
        if len(w) > 40:
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
            texts.append(t.upper() if t.isascii() else t)
    texts += [None, "", " \t\n", "one", "One", "one two\x0bthree", "one two three"]
    docs = list(enumerate(texts))
    rows = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    prints = {d: plain_print(t) for d, t in docs}
    assert {r.doc_id: r.print & (1 << 64) - 1 for r in rows} == prints
    want = groups(prints)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert sorted(r.doc_id for r in rows if r.keep) == sorted(set(want.values()))


def links_of(spark, prints, **options):
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    return [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, **options).collect()]


@pytest.mark.parametrize("tile", [8, 64, 2048])
def test_dense_groups_keep_every_link(spark, tile, monkeypatch):
    """A ball of many fingerprints around one, in keys larger than a tile."""
    monkeypatch.setattr(simhash, "SMALL", 4)
    r = random.Random(4)
    center = r.getrandbits(64)
    prints = {center}
    while len(prints) < 150:
        p = r.choice(sorted(prints)) if r.random() < 0.5 else center
        for _ in range(r.choice([1, 2, 3, 4])):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    prints |= {r.getrandbits(64) for _ in range(50)}
    found = links_of(spark, prints, tile=tile)
    low = {p: p for p in prints}

    def root(p):
        while low[p] != p:
            p = low[p]
        return p

    for a, b in found:
        x, y = root(a), root(b)
        low[max(x, y)] = min(x, y)
    assert {p: root(p) for p in prints} == groups({p: p for p in prints})
    assert len(found) < 20 * len(prints)


def test_pivots_never_lose_a_near_pair():
    r = np.random.default_rng(1)
    p = r.integers(0, 1 << 64, 500, dtype="u8")
    q = p.copy()
    for _ in range(3):
        q ^= np.uint64(1) << r.integers(0, 64, 500).astype("u8")
    assert np.abs(simhash.distances(p) - simhash.distances(q)).max() <= 3
    assert len(simhash.blocks(3)) == 20 and all(64 * 3 // 6 - 2 <= m.bit_count() <= 34 for m in simhash.blocks(3))


def test_chains_of_components(spark):
    chain = [(i + 1, i) for i in range(200)] + [(1000, 1001), (5000, 5000)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


def test_nulls_repeats_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "other words here")], "doc_id long, text string")
    rows = simhash.near_duplicates(d).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "7"), ("None", "None")]
    assert sum(r.keep for r in rows) == 2 and sum(r.keep for r in rows if r.doc_id == 7) == 1
    assert simhash.near_duplicates(d.where("false")).count() == 0
    odd = d.selectExpr("doc_id", "text", "1 as PRINT", "'k' as keep", "2 as uid", "3 as `a b`")
    assert simhash.near_duplicates(odd).first()["a b"] == 3


def test_very_long_text():
    t = "alpha beta gamma delta " * 60_000
    assert simhash.fingerprint(t) == plain_print(t)


def test_edges_between_batches():
    """A key that goes on over many record batches is connected all the same."""
    p = np.array([5, 4, 6, 0xFFFF << 48, 7], "u8")
    d = simhash.distances(p)
    row = lambda i: pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array(p[i : i + 1].view("i8")), pa.array([d[i].tobytes()]), pa.array([0])], ["key", "cell", "print", "distances", "side"])
    found = {(a, b) for batch in simhash._connect(3)(row(i) for i in range(5)) for a, b in zip(*batch.to_pydict().values())}
    assert {a for a, _ in found} | {b for _, b in found} == {4, 5, 6, 7}


@pytest.mark.parametrize("crowd", [8, 40])
def test_crowds_are_cut_by_further_blocks(spark, crowd):
    """All fingerprints agree on three blocks; every link is kept, whatever makes a crowd."""
    r = random.Random(crowd)
    mask = simhash.blocks(3)[7]
    base, free = r.getrandbits(64), [i for i in range(64) if not mask >> i & 1]
    prints = {base}
    while len(prints) < 200:
        p = r.choice(sorted(prints)) if r.random() < 0.7 else (base & mask) | (r.getrandbits(64) & ~mask & (1 << 64) - 1)
        for _ in range(r.choice([1, 2, 3])):
            p ^= 1 << r.choice(free)
        prints.add(p)
    found = links_of(spark, prints, crowd=crowd)
    low = {p: p for p in prints}

    def root(p):
        while low[p] != p:
            p = low[p]
        return p

    for a, b in found:
        x, y = root(a), root(b)
        low[max(x, y)] = min(x, y)
    assert {p: root(p) for p in prints} == groups({p: p for p in prints})


def test_further_blocks():
    for m in simhash.blocks(3):
        again = simhash.further_blocks(m, 3)
        assert len(again) == 20 and all(x & m == 0 and 14 <= x.bit_count() <= 18 for x in again)


def test_compared_pairs_of_a_crowd_grow_less_than_the_square(spark):
    mask = np.uint64(simhash.blocks(3)[0])
    pairs = {}
    for n in (4_000, 100_000):
        p = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype="u8") & ~mask | np.uint64(12345) & mask)
        df = spark.createDataFrame(pa.table({"print": pa.array(p.view("i8"))}))
        sides = simhash.cells(df).groupBy("key", "cell").agg(F.count_if(F.col("side") != 2).alias("l"), F.count_if(F.col("side") != 1).alias("r"))
        pairs[n] = sides.agg(F.sum(F.col("l") * F.col("r"))).first()[0]
    # From a key that isn't cut to one 25 times as large: the square would be 625 times as many.
    assert pairs[100_000] < 100_000**2 / 100 and pairs[100_000] < 25 * pairs[4_000]


def test_a_hub_of_links(spark):
    """A star in which one node has nearly all links: tasks of its joins are split."""
    hub = spark.range(1, 60_001).selectExpr("id as a", "0L as b").union(spark.range(1, 100).selectExpr("id + 100000 as a", "id as b"))
    got = connected(hub)
    assert got.count() == 60_099 and got.select("component").distinct().count() == 1
