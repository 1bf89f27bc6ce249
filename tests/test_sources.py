from __future__ import annotations

import json

from pyspark.sql import functions as F

from linkspan.sources import tables


def test_documents(spark, tmp_path):
    entry = {"name": "A", "slug": "a", "poolName": None}
    docs = {"good": {"format": "sources", "version": 1, "sources": [entry, entry | {"slug": "b", "poolName": "p"}]}, "old": {"format": "sources", "version": 9, "sources": [entry]}, "odd": {"x": 1}}
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    got = sorted((r.problem or "", r.slug or "") for r in tables.read_source_documents(spark, str(tmp_path)).collect())
    assert got == [("", "a"), ("", "b"), ("not a document", ""), ("unknown version", "a")]


def test_classify(spark):
    e = spark.createDataFrame([("A", "a", None), ("B", "b", "p"), ("C", "c", "q"), ("D", "c", None), ("", "e", None)], "name string, slug string, poolName string")
    got = {(r.name, r.slug): (r.status, r.pool_status) for r in tables.classify_entries(e, spark.createDataFrame([("b",)], "slug string"), spark.createDataFrame([("p",)], "name string")).collect()}
    assert got == {("A", "a"): ("new", "none"), ("B", "b"): ("conflict", "resolved"), ("C", "c"): ("invalid", "missing"), ("D", "c"): ("invalid", "none"), ("", "e"): ("invalid", "none")}


def test_feed(spark):
    lines = ["# note", "", "h:80:u:p", "h:80:u2:p2", "h:x:u:p", "h:70000:u:p", "h:81::p", "h:82:u", "g:9:u:p"]
    got = {tuple(r) for r in tables.parse_feed(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).collect()}
    assert got == {("h", 80, "u2", "p2"), ("g", 9, "u", "p")}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"tags": "x", "city": "Roma"}), ("é", None)], "id string, extra map<string,string>")
    tables.export_csv(rows, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), "id string, extra string")
    assert {tuple(r) for r in back.collect()} == {("a", '{"city":"Roma","tags":"x"}'), ("é", None)}
    tables.export_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_manifest_is_independent_of_order(spark):
    rows = spark.createDataFrame([("f", i, f"line {i}") for i in range(50)], "file string, n long, line string")
    a, b = (tables.manifest(r, "file", F.col("line")).first() for r in (rows, rows.orderBy(F.col("n").desc()).repartition(7)))
    assert a == b and a.rows == 50
