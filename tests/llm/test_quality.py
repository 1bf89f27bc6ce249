from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspan.llm import quality_gbt as gbt
from linkspan.llm import quality_knn as knn

SF = "/root/testdata/sf0.01"


def plain_stats(text):
    text = text or ""
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    words = find(text)
    lines = [x for x in text.split("\n") if find(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_statistics():
    r = random.Random(10)
    texts = ["", " \n\t", "one", None, "a b c d e f g h a b c d e f g h", "x " * 20, "# * $ % & | < >", "l\nl\n \nl2\nl", "été 漢字\x0bx\x85y z"]
    texts += [" ".join(r.choice("abc") for _ in range(r.choice([8, 9, 40, 200]))) for _ in range(100)] + ["a b\n" * 30_000]
    for t in texts:
        assert gbt.document_stats(t)[0] == plain_stats(t), t


def test_flat_trees_walk_like_nested_ones():
    r = np.random.default_rng(11)
    x = r.normal(size=(400, len(gbt.FEATURES)))
    y = (x[:, 2] + 0.5 * x[:, 0] + r.normal(size=400) * 0.3 < 0).astype(float)
    forest = gbt.grow(x, y, list(gbt.FEATURES.values()), rounds=10)

    def one(row):
        total = forest.base
        for n in forest.roots:
            while forest.feature[n] >= 0:
                n = forest.left[n] if row[forest.feature[n]] <= forest.threshold[n] else forest.right[n]
            total += forest.value[n]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.probability(x[:50]), [one(v) for v in x[:50]])
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.85


def test_constraints_hold():
    r = np.random.default_rng(12)
    x = r.normal(size=(500, len(gbt.FEATURES)))
    forest = gbt.grow(x, (np.sin(3 * x[:, 3]) + x[:, 0] > 0).astype(float), list(gbt.FEATURES.values()))
    for f, sign in enumerate(gbt.FEATURES.values()):
        if sign:
            probe = np.repeat(x[:40], 30, 0)
            probe[:, f] = np.tile(np.linspace(-3, 3, 30), 40)
            p = forest.probability(probe).reshape(40, 30)
            assert (sign * np.diff(p, axis=1) >= -1e-12).all()


def test_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = gbt.fit_rules(docs, labels.where("doc_id % 2 = 0"))
    rows = gbt.apply_rules(docs, forest).join(labels, "doc_id").where("doc_id % 2 = 1").select("kept", labels["quality"].alias("y")).collect()
    assert np.mean([r.kept for r in rows if r.y == 1]) > 0.9 and np.mean([r.kept for r in rows if r.y == 0]) < 0.4
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "w " * 19), (3, " ".join(f"w{i}" for i in range(20)))], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = gbt.apply_rules(odd, forest).collect()
    assert len(got) == 5 and [r.base_failed for r in sorted(got, key=lambda r: r.n_words)] == [True] * 4 + [False]
    assert gbt.apply_rules(docs.where("false"), forest).count() == 0
    empty = gbt.fit_rules(docs, labels.where("false"))
    assert not len(empty.roots) and gbt.apply_rules(docs.limit(5), empty).count() == 5


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return knn.fit_knn(docs, labels, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = knn.score_documents(docs, model).join(held.select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r.predicted for r in rows if r.quality == y] for y in (1, 0))
    assert len(good) > 40 and np.mean(good) > 0.95 and np.mean(bad) < 0.5


def test_votes_are_exact_cosines(model):
    texts = ["the quick brown fox", "### $$$ %%%", "x" * 500, "ein kurzer text"]
    x = np.array([knn.counts(t) for t in texts])
    got = knn.vote(x, model)
    for t, s in zip(x, got):
        v = np.log1p(t) * model.idf
        v = v / np.linalg.norm(v) @ model.basis
        c = np.round(model.vectors @ (v / np.linalg.norm(v)), 6)
        near = np.argsort(-c, kind="stable")[: knn.NEIGHBOURS]
        w = np.maximum(c[near], 0).astype("f8") ** model.power * model.weights[near]
        assert abs(s - (w * model.labels[near]).sum() / w.sum()) < 1e-4


def test_counts_of_long_texts(monkeypatch):
    text = "añb c" * 1000
    whole = knn.counts(text)
    monkeypatch.setattr(knn, "STRIDE", 17)
    assert (knn.counts(text) == whole).all() and whole[:-1].sum() == len(text.encode()) - 2 and whole[-1] == 998
    assert knn.counts("a a a b b\nb A")[-1] == 4


def test_knn_edges(spark, model):
    odd = spark.createDataFrame([(None, None, 5), (1, "", 5), (1, "", 5), (2, "ab", 5)], "doc_id long, text string, Score int")
    rows = knn.score_documents(odd, model).collect()
    assert [r.score for r in rows] == [pytest.approx(model.prior)] * 4
    assert knn.score_documents(odd.where("false"), model).count() == 0
    labels = spark.createDataFrame([(None, 1), (2, None), (3, 7), (4, 1)], "doc_id long, quality int")
    lone = knn.fit_knn(odd, labels)
    assert knn.score_documents(odd, lone).first().score == 1.0
    assert knn.fit_knn(odd, labels.where("false")).prior == 0.5


def test_ties_go_to_the_first_ids(spark):
    """Of more equal neighbours than may vote, those of the smallest doc_id do."""
    r = np.random.default_rng(3)
    c = r.integers(0, 4, (200, 60)) / 4
    assert (knn.nearest(c, 25) == np.sort(np.argsort(-c, axis=1, kind="stable")[:, :25], axis=1)).all()
    docs = spark.createDataFrame([(i, "the same text of all") for i in range(60)] + [(99, "the same text of all")], "doc_id long, text string")
    for low in (0, 1):
        labels = spark.createDataFrame([(i, low if i < 30 else 1 - low) for i in range(60)], "doc_id long, quality int")
        assert knn.score_documents(docs.where("doc_id = 99"), knn.fit_knn(docs, labels)).first().score == low


def test_choice_by_inner_folds():
    """What is chosen depends on the rows learned from alone, and the simplest of equally good ones is taken."""
    r = np.random.default_rng(5)
    x = np.zeros((90, knn.WIDTH + 1), "f4")
    x[:, :50] = r.integers(0, 3, (90, 50))
    y = (np.arange(90) // 3 % 2).astype("f8")
    x[:, knn.WIDTH] = y * 40  # repeated words alone tell
    assert knn.choose(x, y, {0: 45, 1: 45})[0] > 0
    x[:, knn.WIDTH] = 0  # now they are all alike
    x[:, :20] += (y[:, None] * 9).astype("f4")
    assert knn.choose(x, y, {0: 45, 1: 45})[0] == 0
    assert knn.auc(np.array([0.1, 0.5, 0.5, 0.9]), np.array([0, 0, 1, 1])) == 0.875


def test_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    held = labels.where(fold == 0).select("doc_id", F.col("quality").alias("y"))
    rows = gbt.apply_rules(docs, gbt.fit_rules(docs, labels, where=fold != 0)).join(held, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.y == y] for y in (1, 0))
    assert len(good) > 40 and np.mean(good) > 0.9 and np.mean(bad) < 0.3


def test_rules_on_very_long_texts_and_at_the_threshold(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (1, long), (2, "one two three"), (None, None)], "doc_id long, text string")
    share = gbt.grow(np.zeros((4, len(gbt.FEATURES))), np.array([0.0, 1, 1, 1]), list(gbt.FEATURES.values()))  # nothing to split on: one probability for all
    p = float(share.probability(np.zeros((1, len(gbt.FEATURES))))[0])
    for threshold, kept in ((p, True), (np.nextafter(p, 1), False)):
        rows = gbt.apply_rules(docs, share, threshold).collect()
        assert [r.kept for r in rows if r.doc_id == 1] == [kept] * 2 and not any(r.kept for r in rows if r.doc_id != 1)
        assert [r.n_words for r in rows if r.doc_id == 1] == [400_000] * 2 and all(r.quality == p for r in rows)
    want = plain_stats(long)
    got = next(r for r in rows if r.doc_id == 1)
    assert [got[s] for s in gbt.STATS] == want[: len(gbt.STATS)]
