"""Every query beside its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import re
import unicodedata
from html.parser import HTMLParser

import duckdb
import pytest

from linkspan.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


#: Queries that parse pages, each once in Arrow batches.
OF_PAGES = {"html_text", "html_values", "html_pairs", "html_items", "html_fields", "html_paths"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name in OF_PAGES or "Python" not in plan and "Arrow" not in plan  # built-in functions wherever they do
    assert name in OF_PAGES or "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        return
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, rel.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["status_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(o_orderstatus" in plan
    assert "ReadSchema: struct<o_orderstatus:string>" in plan


def test_summary_hash_by_pythons_json(spark):
    from tests.test_functions import LINK, PHONE

    of = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        of.setdefault(r.conv_id, []).append((r.turn, r.role, PHONE.sub("[PHONE REDACTED]", LINK.sub("[URL REDACTED]", r.text or ""))))
    want = {}
    for conv, turns in of.items():
        refs, adverts = {}, []
        for turn, role, text in sorted(turns):
            ref = refs.setdefault(role, f"source-{len(refs) + 1}")
            adverts.append({"source_ref": ref, "title": role[:500], "description": text[:4000], "scraped_at": str(turn)})
        envelope = {"provider": "local", "model": "small", "prompt_version": "v1", "payload": {"advertisements": adverts, "forum_snippets": []}, "record_content_revision": len(turns)}
        want[conv] = hashlib.sha256(json.dumps(envelope, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert {r.conv_id: r.input_hash for r in QUERIES["summary_hash"](spark, SF).collect()} == want


def test_paragraphs_by_a_plain_reader(spark):
    """A paragraph lasts to its end tag, the next block or the end of what holds it."""

    class Plain(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.found, self.now = [], None
            self.feed(html)
            self.close()
            self.end()

        def end(self):
            if self.now is not None and (text := "\n".join(" ".join(x.split()) for x in self.now.split("\0")).strip()):
                self.found.append(text)
            self.now = None

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "ul", "div", "h1", "nav", "article", "footer", "section"):
                self.end()
            if tag == "p":
                self.now = ""
            elif tag == "br" and self.now is not None:
                self.now += "\0"

        def handle_endtag(self, tag):
            if tag in ("p", "article", "div", "body"):
                self.end()

        def handle_data(self, data):
            if self.now is not None:
                self.now += data

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {(r.page_id, r.ordinal): r.value for r in QUERIES["html_text"](spark, SF).collect()}
    assert got == {(p.page_id, i): t for p in pages for i, t in enumerate(Plain(p.html).found)}


def test_duplicate_links_by_hash_address_or_title_and_description(spark, tmp_path):
    page = lambda t, d: f"<title>{t}</title><article>{d}</article>"
    rows = [(1, "http://a.x/1", page("T", "d")), (2, "http://a.x/2", page("t ", "D\n")), (3, "http://a.x/3", page("T", "other")), (4, "http://A.x/3/?ref=q", page("V", "e")), (5, "http://a.x/5", page("", "d")), (6, "http://a.x/6", page("", " d")), (7, "", page("W", "w")), (8, "", page("U", "u")), (9, "http://a.x/9", page("T", "d"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    links = QUERIES["duplicate_links"](spark, str(tmp_path))
    assert sorted((r.low, r.id) for r in links.collect()) == [(1, 2), (1, 9), (3, 4)]
    assert "pages.parquet" not in str(links.inputFiles())  # the pages were read once, for all keys


def test_duplicate_pairs_compare_whole_texts(spark, tmp_path):
    """A common opening links nothing; spacing and case don't matter, near the start or far from it."""
    head = "licence line " * 10
    docs = [(1, head + "one text"), (2, head + "another text"), (3, (head + "ONE  text").replace(" ", "\n ")), (4, head + "another text"), (5, ""), (6, ""), (7, " \n"), (8, None), (9, None), (10, "\t")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    links = QUERIES["duplicate_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.low, r.id) for r in links) == [(1, 3), (2, 4), (5, 6)]


def test_accents_are_folded_in_whole_texts(spark, tmp_path):
    """Against NFKD of every word: accents, runs and the alias far from the start."""
    texts = ["plain opening of a text, then Città-di-Càstello and\tAGE", "x" * 40 + " Ñandú ÀÉÎÕÜ (été) ß_ 12--ab", "", None, "--"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    bare = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower()
    keys = {re.sub("[^a-z0-9]+", "_", bare(w)).strip("_") for t in texts for w in (t or "").split()}
    want = {"eta" if k == "age" else k for k in keys}
    assert {"citta_di_castello", "eta", "nandu", "aeiou", "ete", "12_ab"} <= want
    assert sorted(r.key for r in QUERIES["accent_fold_words"](spark, str(tmp_path)).collect()) == sorted(want)


def test_words_are_folded_once_each(spark):
    """A distinct right below another is dropped by Spark's optimizer, and every place of a word is folded."""
    plan = QUERIES["accent_fold_words"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [line.split("[")[1].split("#")[0] for line in plan.splitlines() if "Aggregate [" in line] == ["key", "word"]


def test_references_without_a_semicolon_stay(spark, duck, tmp_path):
    """As in a title that was cut inside one; scripts have no references."""
    pages = [(i, f"https://a.x/{i}", f"<title>{t}</title><script>var x = '<a href=\"' + a&b&amp;c</script><a href=\"/x?a=1&b=2\">x</a>") for i, t in enumerate(["the&amp;&amp;&amp", "a &lt b &lt;", "&amp;amp", "&#39;&#39 &x27;", "&", "R&D; &quot"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = QUERIES["html_fields"](spark, str(tmp_path))
    want = duck.execute(f"WITH pages AS (FROM '{tmp_path}/pages.parquet/*.parquet') SELECT {', '.join(df.columns)} FROM ({ORACLES['html_fields']})").fetchall()
    assert {r.page_id: r.title for r in df.collect()}[0] == "the&&&amp"
    assert rows(df.columns, df.collect()) == rows(df.columns, want)


def test_addresses_are_made_by_all_tasks(spark):
    """Customers are few bytes in one file, of which many addresses are made."""
    assert QUERIES["url_parameters"](spark, SF).rdd.getNumPartitions() >= 4
