from __future__ import annotations

import hashlib
import random
import re

import pytest

from linkspan.llm.decontaminate import benchmark_windows, candidates, decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    """By plain comparison of every window with every place."""
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                x = windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None
                if x:
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(d, b, **options).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted(map(tuple, rows), key=repr)


def test_against_brute_force(spark):
    r = random.Random(5)
    some = lambda n, v: " ".join(r.choice("abcdefghijklmnopqrst"[:v]) for _ in range(n))
    items = [(i, some(r.choice([1, 2, 3, 9, 10, 11, 25]), 20)) for i in range(15)] + [(3, some(12, 20)), (None, some(12, 20)), (40, ""), (41, None), (42, "...")]
    items += [(50, "a a a a a a a a a a a a"), (51, "a a a a a a a a a a"), (52, "Ünï 漢字 x1"), (53, "one")]
    docs = [(i, some(r.choice([0, 1, 5, 40, 200]), 20)) for i in range(40)]
    docs += [(100 + k, f"{some(5, 20)} {t}! {some(7, 20)}") for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "A a, a. " * 300), (204, "xünï 漢字 x1"), (204, "ÜNÏ 漢字 x1"), (205, "Ünï-漢字\x00X1"), (None, "one"), (None, None)]
    assert got(spark, docs, items) == brute(docs, items)


def test_long_text_and_ties(spark):
    passage = " ".join(f"w{i % 7}" for i in range(60))
    docs = [(1, " ".join(f"w{i % 7}" for i in range(20_000))), (2, passage), (2, passage), (3, passage[:-1])]
    items = [(1, passage), (2, passage), (3, "w0 w1 w2")]
    assert got(spark, docs, items) == brute(docs, items)


@pytest.fixture
def no_broadcasts(spark, monkeypatch):
    monkeypatch.setattr("linkspan.llm.decontaminate.BROADCAST_ROWS", -1)
    monkeypatch.setattr("linkspan.llm.decontaminate.BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffled_instead_of_broadcast(spark, no_broadcasts):
    r = random.Random(6)
    some = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    items = [(1, "one two three four five six seven eight nine ten eleven"), *((i, some(r.choice([1, 2, 3, 10, 12]))) for i in range(2, 9))]
    docs = [(1, "x " + items[0][1]), (2, "one two three"), (3, None), *((i, some(60)) for i in range(4, 12))]
    assert got(spark, docs, items) == brute(docs, items)


def test_no_words_are_shuffled_with_shingles(spark, no_broadcasts):
    docs = spark.createDataFrame([(1, "a b c d", 4)], "uid long, words string, n_words int")
    windows = spark.createDataFrame([(7, "b c d", 3)], "wid long, window string, n int")
    found = candidates(docs, windows, [3], 3)
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    dealt = [block for block in text.split("\n\n") if ") Exchange" in block]
    assert len(dealt) == 2 and "BroadcastExchange" not in text
    assert not any(re.search(r"(?<!n_)words#", block) for block in dealt)
    assert [tuple(r) for r in found.collect()] == [(1, 7, 1, 3)]


def test_empty_tables_and_clashing_columns(spark):
    assert got(spark, [], [(1, "a b")]) == []
    assert got(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
    d = spark.createDataFrame([(1, "a b", 5, "x", True)], "doc_id long, text string, uid int, `odd name` string, N_Hit boolean")
    row = decontaminate(d, spark.createDataFrame([(7, "a b")], "item_id long, text string")).first().asDict()
    assert (row["odd name"], row["uid"], row["n_hit"], row["contaminated"]) == ("x", 5, 2, True)


def test_windows(spark):
    rows = benchmark_windows(spark.createDataFrame([(1, "A b; c")], "item_id long, text string"), width=2).collect()
    assert {(r.window, r.n) for r in rows} == {("a b", 2), ("b c", 2)}


def test_main_path_is_native(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontaminate(d, spark.createDataFrame([(7, "a b")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("width", [1, 2, 4])
def test_other_widths(spark, width):
    out = got(spark, [(1, "x a b c y"), (2, "a c b")], [(9, "a b c")], width=width)
    assert [r[2] for r in out] == ([3, 3] if width == 1 else [3, 0])
