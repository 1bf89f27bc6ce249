from __future__ import annotations

import hashlib
import random
import re

import pytest

from linkspan.llm.line_dedup import dedup_lines

P, B = 2_147_483_647, 1_000_003


def brute(docs):
    """The chunks by their definition, in order of doc_id (nulls last) and row."""
    def spans(lines):
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % P for x in lines]
        r = [((B + (h[i - 1] if i else 0)) % P * B + h[i]) % P for i in range(len(h))]
        n = len(lines)
        places = {(i, i) for i in range(n) if lines[i].count(" ") >= 49}
        for f in range(4):
            for i in range(n - 1):
                places.add((i, next((e for e in range(i + 1, min(i + 4, n)) if r[e] >> f & 1), min(i + 4, n - 1))))
        count = [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in lines]
        for i in range(n):  # the shortest runs of fifty words from line i on, and up to line i
            if count[i]:
                places |= {(i, e) for e in range(i, n) if sum(count[i:e]) < 50 <= sum(count[i : e + 1])}
                places |= {(a, i) for a in range(i + 1) if sum(count[a + 1 : i + 1]) < 50 <= sum(count[a : i + 1])}
        for a, b in places:
            chunk = "\n".join(lines[a : b + 1])
            if chunk.strip(" \n"):
                yield a, b + 1, chunk

    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    places = {}
    for k in order:
        for a, b, chunk in set(spans(docs[k][1].split("\n"))) if docs[k][1] is not None else ():
            places.setdefault(chunk, []).append((order.index(k), a, b, k))
    gone = {}
    for p in places.values():
        for _, a, b, k in sorted(p)[1:]:
            gone.setdefault(k, set()).update(range(a, b))
    out = []
    for k, (d, t) in enumerate(docs):
        lines = t.split("\n") if t is not None else []
        left = [x for i, x in enumerate(lines) if i not in gone.get(k, ())]
        out.append((d, None if t is None else "\n".join(left), len(lines), len(gone.get(k, ()))))
    return sorted(out, key=repr)


def got(spark, docs):
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in rows), key=repr)


def test_against_brute_force(spark):
    r = random.Random(6)
    line = lambda: " ".join(r.choice("ab cd éf g".split()) for _ in range(r.choice([1, 3, 8])))
    passage = [line() for _ in range(9)]
    long = " ".join(r.choice("abcdefgh") for _ in range(55))
    docs = []
    for i in range(60):
        body = [line() for _ in range(r.choice([0, 1, 4, 15]))]
        if i % 3 == 0:
            at = r.randrange(len(body) + 1)
            body[at:at] = passage
        if i % 5 == 0:
            body.append(long)
        docs.append((i, "\n".join(body)))
    docs += [(3, docs[3][1]), (None, docs[0][1]), (None, docs[0][1]), (100, None), (101, ""), (102, "\n\n\n"), (103, "\n".join(["same"] * 500)), (104, "x\r\ny\r\n" * 5)]
    want = brute(docs)
    assert got(spark, docs) == want
    assert sum(w[3] for w in want) > 100


def test_nothing_is_lost(spark):
    """Each removed line is still somewhere, and clean documents stay as they are."""
    r = random.Random(7)
    lines = [f"line {i} {r.random()}" for i in range(30)]
    docs = [(i, "\n".join(lines[j % 30] for j in range(i, i + 12))) for i in range(30)] + [(99, "alone\nand\nclean")]
    rows = got(spark, docs)
    left = {x for _, t, _, _ in rows for x in t.split("\n")}
    assert set(lines) <= left and (99, "alone\nand\nclean", 3, 0) in rows


def test_long_single_lines_and_shifts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"intro one\n{words}\nend one"), (2, f"a\nb\nc\nd\n{words}"), (3, words.rsplit(" ", 20)[0])]
    rows = {d: (t, n) for d, t, _, n in got(spark, docs)}
    assert rows[1][1] == 0 and rows[2] == ("a\nb\nc\nd", 1) and rows[3][1] == 0


def test_empty_and_clashing(spark):
    d = spark.createDataFrame([(1, "a\nb", 3, "u", 1), (2, "a\nb", 3, "v", 2)], "doc_id long, text string, n_chars int, uid string, `a b` int")
    assert dedup_lines(d.where("false")).count() == 0
    rows = {r.doc_id: r for r in dedup_lines(d).collect()}
    assert set(rows[1].asDict()) == {"doc_id", "text", "n_chars", "uid", "a b", "n_lines", "n_removed"}
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_main_path_is_native(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_runs_leave_no_passage_of_fifty_words(spark):
    """Planted passages of two, three and twelve lines go whole; those of under fifty words in new lines stay."""
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passages = [[line(30), line(30)] for _ in range(20)] + [[line(20), line(20), line(20)] for _ in range(20)] + [[line(5), "", *[line(5) for _ in range(10)]] for _ in range(20)]
    docs = [(i, "\n".join([line(7), *p, line(6)])) for i, p in enumerate(passages)]
    again = [(100 + i, [line(8), line(3)], [line(9)]) for i in range(len(passages))]
    docs += [(d, "\n".join([*before, *p, *after])) for (d, before, after), p in zip(again, passages)]
    docs += [(500, "\n".join([line(10), passages[0][1], line(10)])), (501, None), (502, ""), (503, " \n\n ")]
    rows = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), runs=True).collect()}
    assert all(rows[d] == "\n".join([*before, *after]) for d, before, after in again)
    assert all(rows[d] == t for d, t in docs if d < 100 or d >= 500)


def test_runs_of_the_pipeline(spark):
    import corpus_pipeline

    r = random.Random(9)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passages = [[line(26), line(26)] for _ in range(20)]
    docs = [(k, f"{line(5)}\n{p[0]}\n{p[1]}\n{line(5)}") for k, p in enumerate(passages + passages)]
    rows = corpus_pipeline.line_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert all(len(x.text.split()) == (62 if x.doc_id < 20 else 10) for x in rows)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 10])
def test_recall_of_short_passages(spark, n):
    """Lines of repeated passages of under fifty words that go, by number of lines: 0.9 of two, nearly all of more."""
    r = random.Random(n)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(4))
    passages = [[line() for _ in range(n)] for _ in range(400)]
    docs = [(k, "\n".join([line(), *p, line()])) for k, p in enumerate(passages + passages)]
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_removed").collect()
    assert sum(x.n_removed for x in rows if x.doc_id < 400) == 0
    assert sum(x.n_removed for x in rows) >= (0.9 if n == 2 else 0.96) * n * 400


@pytest.mark.parametrize("shuffled", [False, True])
def test_lines_of_equal_hashes(spark, monkeypatch, shuffled):
    """Where lines of unlike bytes have equal hashes, chunks are compared by their text."""
    from pyspark.sql import functions as F

    from linkspan.llm import line_dedup

    def hashed(rows):
        rows = rows.withColumn("lines", line_dedup._lines())
        return rows.withColumns({c: F.transform("lines", lambda x: F.length(x).cast("long")) for c in ("x", "h")})

    monkeypatch.setattr(line_dedup, "_hashed", hashed)
    if shuffled:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    docs = [(1, "ab\ncd"), (2, "xy\nzw"), (3, "ab\ncd"), (4, "ab\nzz")]
    rows = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: 0, 2: 0, 3: 2, 4: 0}
