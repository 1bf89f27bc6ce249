"""The pipeline's stages on their own inputs, and the queries over whole tables."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkspan.llm import queries
from linkspan.llm.decontaminate import decontaminate

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts], SCHEMA)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, seen = docs.count(), []
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        seen.append(docs.count())
        assert docs.select("doc_id").distinct().count() == seen[-1] and 0 < seen[-1] <= n
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.6 * n
    total = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in total.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == seen[-1]


def test_one_of_each_group_stays(spark):
    r = random.Random(13)
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(99)) for _ in range(400)) for _ in range(8)]
    near = [(10 + i, " ".join(w if k % 60 else "edit" for k, w in enumerate(t.split()))) for i, t in enumerate(texts)]
    rows = [*enumerate(texts), *near, (30, texts[0]), (31, None), (32, "")]
    got = {x.doc_id for x in stage("near_dedup")(spark, docs_of(spark, rows), SF).collect()}
    assert got == {*range(8), 31}


def test_leaks_go_and_clean_ones_stay(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, f"before it {item} and after"), (2, "nothing of that kind is here"), (3, item.upper() if item.isascii() else item), (4, None)]
    assert {x.doc_id for x in stage("decontamination")(spark, docs_of(spark, rows), SF).collect()} == {2, 4}


def test_passages_are_cut_once(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(8))
    rows = [(i, f"own line {i} a\nown line {i} b\n{passage}\nend {i}") for i in range(5)] + [(9, "clean\ntext")]
    got = {x.doc_id: x for x in stage("line_dedup")(spark, docs_of(spark, rows), SF).collect()}
    assert got[0].text == rows[0][1] and got[9].text == "clean\ntext" and len(got) == 6
    assert all(len(got[i].text) < len(rows[i][1]) / 2 and got[i].n_chars == len(got[i].text) for i in range(1, 5))


def test_empty_input(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rel.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_tables(spark, name):
    out = queries.QUERIES[name](spark, SF)
    key, source = {"op4": ("page_id", "pages"), "op13": ("vec_id", "embeddings")}.get(name.split("_")[0], ("doc_id", "documents"))
    assert out.select(key).distinct().count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_op2_is_in_its_form(spark):
    r = queries.QUERIES["op2_simhash_pivots"](spark, SF)
    assert r.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$") | (F.col("component_id") > F.col("doc_id"))).count() == 0


def test_a_null_benchmark_is_harmless(spark):
    none = spark.createDataFrame([(None, None)], "item_id long, text string")
    assert decontaminate(docs_of(spark, [(1, "a b")]), none).first().contaminated is False


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_clashing_columns(spark, name):
    """Columns with the operators' own names stay as they are; nulls, repeats and long texts pass every stage."""
    own = "uid score predicted words print keep n_words n_hit n_lines n_removed component component_id contaminated aside_0 key ids".split()
    texts = [(1, "the first of the texts is here and it is as it was"), (2, None), (3, ""), (None, "no id here"), (5, "same text"), (5, "same text"), (6, "long and longer text of the words " * 20_000)]
    rows = [(i, t, *(f"{c}-{k}" for c in own)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in own))
    out = stage(name)(spark, docs, SF)
    got = [r.asDict() for r in out.collect()]
    if name == "packing":
        assert {r["doc_id"] for r in got} == {1, 2, 3, None, 5, 6} and sum(r["start"] == 0 for r in got) == 7
        return
    assert out.columns == docs.columns
    assert all(r[c].startswith(f"{c}-") and len({r[x].split("-")[1] for x in own}) == 1 for r in got for c in own)
    assert len({r["uid"] for r in got}) == len(got)
    if name == "near_dedup":
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "5", "6", "None"]
    elif name == "decontamination":
        assert len(got) == 7
    elif name == "line_dedup":
        assert len(got) == 7 and next(r for r in got if r["doc_id"] == 1)["text"] == texts[0][1]
