from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linkspan.llm import similar


def brute(docs, similarity=0.8, words=5):
    sets = [similar.shingles(t, words) for _, t in docs]
    low = list(range(len(docs)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if similar.jaccard(sets[i], sets[j]) >= similarity:
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    return sorted(sorted(g) for g in groups.values())


def found(spark, docs):
    rows = similar.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert all(k == min(g) for k, g in groups.items())
    assert sorted(r.doc_id for r in rows if r.keep) == sorted(groups)
    return sorted(sorted(g) for g in groups.values())


def edited(r, text, share):
    w = text.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def some(r, n):
    return " ".join(f"w{r.randrange(3000)}" for _ in range(n))


@pytest.mark.parametrize("tile", [6, 256])
def test_groups_equal_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(similar.similar_groups, "__defaults__", (0.8, 5, similar.RADIUS, tile))
    r = random.Random(14)
    boilerplate = some(r, 120)
    docs = []
    for k in range(40):
        base = some(r, r.choice([30, 100, 300]))
        docs += [base, *[edited(r, base, r.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.05])) for _ in range(3)]]
    docs += [f"{some(r, 60)} {boilerplate}" for _ in range(40)]  # two thirds in common, not near-copies
    crowd = some(r, 200)
    docs += [edited(r, crowd, r.choice([0.005, 0.015, 0.025])) for _ in range(60)]
    docs += ["", None, " \n", "one two", "ONE\ttwo", "one two three four five six"]
    docs = list(enumerate(docs))
    assert found(spark, docs) == brute(docs)


def test_chain_of_edits(spark):
    r = random.Random(15)
    text, docs = some(r, 300), []
    for i in range(30):
        docs.append((i, text))
        text = edited(r, text, 0.012)
    assert found(spark, docs) == brute(docs)


def test_nulls_repeats_and_names(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "A b c d e f"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as KEEP", "2 as uid", "3 as `x y`")
    rows = similar.similar_documents(d).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.keep) for r in rows) == [("7", "7", False), ("7", "7", True), ("None", "7", False), ("None", "None", True)]
    assert rows[0]["x y"] == 3 and similar.similar_documents(d.where("false")).count() == 0


@pytest.mark.parametrize("n", [5, 9, 24, 40, 100, 400])
def test_recall_by_length(spark, n):
    """Lone pairs just above 0.8, by number of shingles: next to none is lost (0.99 is asked, all are found)."""
    r, pairs = random.Random(n), []
    while len(pairs) < 400:
        a = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
        b = a[:]
        for _ in range(r.choice([1, 2])):
            at = r.choice([0, len(b) - 1, len(b) - 1, r.randrange(len(b))])
            b[at : at + 1] = r.choice([[f"w{r.randrange(10**6)}"], [], [b[at], f"w{r.randrange(10**6)}"]])
        if n > 60:
            b[-n // 13 :] = [f"w{r.randrange(10**6)}" for _ in range(n // 13)]
        if 0.8 <= similar.jaccard(similar.shingles(" ".join(a)), similar.shingles(" ".join(b))) < 1:
            pairs.append((" ".join(a), " ".join(b)))
    rows = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "uid long, text string")
    got = {x.uid: x.component for x in similar.similar_groups(rows).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(len(pairs))) == len(pairs)


def test_a_crowd_apart_is_dealt_by_sizes(spark):
    """Rows of a crowded key are copied far less than once for each tile of 256, and no pair that may be similar is parted."""
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("uid"), (20 + F.col("id") % 400).alias("n"), F.lit(4000).cast("long").alias("size"))
    cells = similar._dealt_out(rows, 0.8, 128).collect()
    assert len(cells) < 4000 * 9
    of = {}
    for c in cells:
        of.setdefault(c.uid, {})[c.cell] = c.side
    r = random.Random(1)
    for _ in range(3000):
        a, b = r.sample(range(4000), 2)
        n, m = sorted((20 + a % 400, 20 + b % 400))
        met = [x for x in of[a] if x in of[b] and (of[a][x] == 0 or of[a][x] != of[b][x])]
        assert len(met) == 1 if n >= 0.8 * m else len(met) <= 1
