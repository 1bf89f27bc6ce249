from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from linkspan.llm.fill_middle import ORACLE, STEP, checkpoints, cut, fill_in_middle, restored, transform
from linkspan.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts():
    r = random.Random(12)
    pieces = [" ", "\n", "\t ", "a", "bé", "漢字", "🙂", "\x0b", "\x1c", "\xa0", "<", "<P", "S>", ">"]
    yield from ["", " ", "\n\n", "a", " a", "a ", "<P>", "x <M> y", "word " * 1000, "é" * 5000]
    for n in [1, 2, 5, 50, STEP, 4 * STEP, 2000] * 20:
        yield "".join(r.choice(pieces) for _ in range(n))


def test_cuts_by_brute_force():
    for t in texts():
        raw, units = t.encode(), UNIT.findall(t)
        index = checkpoints(raw)
        assert index.n == len(units) and "".join(units) == t
        for k in {0, 1, STEP - 1, STEP, STEP + 1, len(units) // 2, len(units)}:
            if k <= len(units):
                before = "".join(units[:k])
                assert cut(raw, index, k) == (len(before.encode()), len(before))


def slow(doc_id, text, seed=42, rate=50, spm_rate=80):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rates", [{}, {"seed": 7, "rate": 100, "spm_rate": 50}])
def test_transform_and_way_back(spark, rates):
    rows = [*enumerate(texts()), (5, None), (6, "long one " * 200_000), (3, "same"), (3, "same")]
    out = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), **rates)
    got = out.withColumn("back", restored()).collect()
    want = sorted((d, *slow(d, t or "", **rates)) for d, t in rows)
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b c", "x", 1), (2, None, None, None)], "doc_id int, text string, FORM string, kept int")
    out = fill_in_middle(docs, rate=100)
    assert out.columns == ["doc_id", "text", "kept", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {(r.doc_id, r.n, r.kept) for r in out.collect()} == {(None, 3, 1), (2, 0, None)}
    assert fill_in_middle(docs.where("false")).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert transform(b"\xff\xfe a b", 1, rate=100)[0] == 3  # bytes that are no UTF-8


def test_query_beside_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES["op12_fill_middle"](spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE})").fetchall())
