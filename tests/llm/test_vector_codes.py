from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspan.llm import vector_codes
from linkspan.llm.queries import QUERIES
from linkspan.llm.vector_codes import ORACLE, compress_vectors, errors_by_label, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and digest by plain loops: every round sums all its parts anew."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    book = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(v[p * width : (p + 1) * width], c), e) for e, c in enumerate(book[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                groups[p, near(v, p)[1]].append(v[p * width : (p + 1) * width])
        for (p, e), g in groups.items():
            book[p][e] = [sum(x) // len(g) for x in zip(*g)]
    out = []
    for i, v, label in kept:
        best = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    by = defaultdict(int)
    for _, _, d, label in out:
        by[label] += d
    digest = hashlib.sha256(",".join(str(x) for p in book for c in p for x in c).encode()).hexdigest()
    return sorted(((i, code, d, by[label]) for i, code, d, label in out), key=repr), digest


def vectors(n, seed=0, dims=8):
    r = np.random.default_rng(seed)
    base = np.round(r.normal(size=(n, dims)) * 0.2, 2).astype("f4").astype(float)
    rows = [(int(i), base[i].tolist(), [0, 0, 1, None][i % 4]) for i in range(n)]
    rows += [(int(i), base[0].tolist(), 0) for i in range(n, n + n // 2)]  # copies of one vector: a third of all rows
    rows += [(900001, None, 0), (900002, [float("nan")] * dims, 1), (900003, [1.0, None] * (dims // 2), 1), (900004, [float("-inf")] * dims, 1), (None, base[1].tolist(), None), (5, base[2].tolist(), 1), (5, base[2].tolist(), 1)]
    return rows


@pytest.mark.parametrize(("n", "entries"), [(60, 16), (300, 256), (3, 256)])
def test_rounds_by_brute_force(spark, n, entries):
    rows = vectors(n, n)
    coded, books = compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in errors_by_label(coded).collect()), key=repr)
    want, digest = slow(rows, entries=entries)
    assert got == want and books.digest == digest


def test_only_changes_are_moved(spark, monkeypatch):
    """The rows that a round adds up are those whose assignment moved, and sums stay equal to sums over all rows."""
    seen, add_up = [], vector_codes._add_up

    def spy(moved, width):
        rows = add_up(moved, width)
        seen.append(rows.agg(F.sum(F.abs("count"))).first()[0] or 0)
        return rows

    monkeypatch.setattr(vector_codes, "_add_up", spy)
    _, books = compress_vectors(spark.createDataFrame(vectors(400, 4), SCHEMA).coalesce(1), entries=8, rounds=8)
    assert seen[0] == 4 * books.counts.sum() // 4 and max(seen[1:]) < seen[0] / 2 and seen[-1] < seen[1]
    assert (books.counts.sum(1) == books.counts.sum(1)[0]).all()


def test_nearest_is_exact_and_takes_the_first_of_equals():
    r = np.random.default_rng(1)
    for most in (3, 1000, vector_codes.MOST):
        x, e = r.integers(-most, most + 1, (200, 4)), r.integers(-most, most + 1, (50, 4))
        d = ((x[:, None, :].astype(object) - e[None]) ** 2).sum(2)
        k, far = nearest(x, e)
        assert k.tolist() == [row.tolist().index(min(row)) for row in d] and far.tolist() == [min(row) for row in d]


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "a", 9), (2, [1.0] * 5, None, 8), (3, [], "b", 7), (4, [1e30] * 5, "a", 6)], "vec_id int, embedding array<double>, Code string, other int")
    coded, books = compress_vectors(df)
    assert coded.columns == ["vec_id", "other", "code", "error"] and books.entries.shape == (4, 4, 2)
    rows = sorted(coded.collect())
    assert [(r.vec_id, r.other) for r in rows] == [(1, 9), (2, 8), (3, 7), (4, 6)] and all(r.error >= 0 for r in rows)
    empty, books = compress_vectors(df.where("false"))
    assert empty.count() == 0 and books.entries.size == 0
    none, _ = compress_vectors(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>"))
    assert [(r.code, r.error) for r in none.collect()] == [("00000000", 0)] * 2


def test_query_beside_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = QUERIES["op13_delta_lloyd"](spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE})").fetchall())
