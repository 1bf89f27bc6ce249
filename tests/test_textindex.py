from __future__ import annotations

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linkspan.operators import textindex


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def slow(docs, asked, phrase):
    want, out = words(asked), {}
    for d, t in docs:
        w = words(t)
        hits = sum(w[i : i + len(want)] == want for i in range(len(w))) if phrase else sum(x in want for x in w) if set(want) <= set(w) else 0
        if d is not None and want and hits:
            out[d] = hits
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = random.Random(4)
    docs = [(i * 37, " ".join(r.choice(["the", "the", "cat", "Été", "x9", "sat-on", "MAT.", "漢字"]) for _ in range(r.choice([0, 1, 5, 60])))) for i in range(300)] + [(5000000, "the " * 30_000 + "end"), (None, "the cat"), (7, None), (9, ""), (11, "same text"), (11, "same text")]
    path = str(tmp_path_factory.mktemp("index") / "words")
    half = len(docs) // 2
    for name, part in (("a", docs[:half]), ("b", docs[half:]), ("a", docs[:half])):  # the first batch comes twice
        textindex.add_batch(spark.createDataFrame(part, "doc_id long, text string"), path, name)
    return path, docs


@pytest.mark.parametrize(("asked", "phrase"), [("the", False), ("cat été", False), ("The CAT", True), ("the the the", True), ("sat on mat", True), ("end", True), ("漢字 x9", False), ("nowhere the", False), ("  ,", True), ("same text", True)])
def test_searches_by_brute_force(spark, index, asked, phrase):
    path, docs = index
    got = {r.doc_id: r.hits for r in textindex.search(spark, path, asked, phrase).collect()}
    assert got == slow(list(dict.fromkeys(docs)), asked, phrase)


def test_many_phrases_at_once(spark, index):
    path, docs = index
    asked = ["the cat", "the the", "x9", "", None, "sat on", "été the cat"]
    got = {(r.query, r.doc_id): r.hits for r in textindex.search_phrases(spark.createDataFrame(list(enumerate(asked)), "query int, text string"), path).collect()}
    assert got == {(i, d): n for i, q in enumerate(asked) for d, n in slow(list(dict.fromkeys(docs)), q, True).items()}


def test_only_the_postings_asked_for_are_read(spark, index):
    path, docs = index
    found = textindex.postings(spark, path, ["cat"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+", plan) and "EqualTo(word,cat)" in plan
    folders = {re.search(r"bucket=(\d+)", r[0])[1] for r in found.select(F.input_file_name()).distinct().collect()}
    assert folders == {str(spark.range(1).select(textindex.bucket_of(F.lit("cat"))).first()[0])}


def test_gaps_are_packed_and_hot_words_are_cut(spark, index):
    path, _ = index
    rows = spark.read.schema(textindex.SCHEMA).parquet(path).where("word = 'the'")
    assert rows.select("block").distinct().count() >= 3 and rows.agg(F.max(F.size("ids"))).first()[0] <= textindex.BLOCK
    file = rows.where("array_contains(ids, 5000000)").inputFiles()[0].removeprefix("file://")
    columns = {c.path_in_schema: c for c in (pq.ParquetFile(file).metadata.row_group(0).column(i) for i in range(4))}
    places = next(c for p, c in columns.items() if p.startswith("places"))
    assert "DELTA_BINARY_PACKED" in places.encodings and places.total_uncompressed_size < 30_000  # of 30,000 places, all gaps of one


def test_a_batch_is_shuffled_once_and_phrases_fetch_what_their_rarest_word_needs(spark, tmp_path, monkeypatch):
    """One exchange builds the index; a frequent word isn't met by every document for each phrase it is in."""
    plans = []
    writer = type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), parquet(self, path, *a, **k))[1])
    docs = [(i, "the the of the" + (" rare word" if i % 50 == 0 else "")) for i in range(200)]
    path = str(tmp_path / "index")
    textindex.add_batch(spark.createDataFrame(docs, "doc_id long, text string"), path, "a")
    assert plans[0].count("Exchange") == 1
    found = textindex.search_phrases(spark.createDataFrame([(1, "the rare"), (2, "the of the"), (3, "rare gone")], "query int, text string"), path)
    assert {(r.query, r.doc_id): r.hits for r in found.collect()} == {(1, i): 1 for i in range(0, 200, 50)} | {(2, i): 1 for i in range(200)}
