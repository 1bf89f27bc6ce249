from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkspan.operators import health, html, linkage, records, series

NOW = datetime(2026, 1, 10, 12)
OCC = "occurrence_id long, record_id long, source string, priority int, status string, confidence double, page int, filled int, scraped_at timestamp_ntz"


def occ(spark, *rows):
    base = {"source": "s", "priority": 1, "status": "active", "confidence": 0.9, "page": None, "filled": 1, "scraped_at": NOW, "record_id": 1}
    names = [c.split()[0] for c in OCC.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], OCC)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([{"occurrence_id": 1, "priority": 3, "scraped_at": NOW}, {"occurrence_id": 2, "priority": 1, "scraped_at": NOW - timedelta(hours=1)}], 2),
        ([{"occurrence_id": 1, "scraped_at": NOW - timedelta(minutes=120)}, {"occurrence_id": 2, "scraped_at": NOW - timedelta(minutes=5)}], 2),
        ([{"occurrence_id": 1, "status": "removed"}, {"occurrence_id": 2, "scraped_at": NOW - timedelta(days=1)}], 2),
        ([{"occurrence_id": 1, "filled": 3, "scraped_at": NOW - timedelta(days=1)}, {"occurrence_id": 2, "filled": 1}], 1),
        ([{"occurrence_id": 1, "page": 1, "priority": 3}, {"occurrence_id": 2, "page": 2, "priority": 1}], 1),
        ([{"occurrence_id": 1, "page": 9}, {"occurrence_id": 2, "page": None}], 1),
        ([{"occurrence_id": 1, "status": "invalid"}], None),
        ([{"occurrence_id": 1}, {"occurrence_id": 2}], 2),
    ],
)
def test_canonical(spark, rows, want):
    got = records.canonical(occ(spark, *rows)).collect()
    assert [r.occurrence_id for r in got] == ([] if want is None else [want])


def test_history_only_when_the_winner_changes(spark):
    rows = occ(spark, {"occurrence_id": 1, "priority": 2, "scraped_at": NOW}, {"occurrence_id": 2, "priority": 3, "scraped_at": NOW + timedelta(1)}, {"occurrence_id": 3, "priority": 1, "scraped_at": NOW + timedelta(2)})
    got = [(r.occurrence_id, r.previous) for r in records.canonical_history(rows).orderBy("scraped_at").collect()]
    assert got == [(1, None), (3, 1)]


RUN = "run_id long, source_id long, status string, started_at timestamp_ntz, items long"


def test_snapshot(spark):
    sources = spark.createDataFrame([(1,), (2,), (3,)], "source_id long")
    at = lambda **k: NOW - timedelta(**k)
    rows = [(1, 1, "failed", at(minutes=5), 0), (2, 1, "failed", at(hours=2), 0), (3, 1, "failed", at(hours=3), 0), (4, 1, "completed", at(days=2), 7), (5, 2, "running", at(minutes=20), None), (6, 2, "failed", None, 0)]
    got = {r.source_id: r for r in health.snapshot(sources, spark.createDataFrame(rows, RUN), F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert (got[1].failed_24h, got[1].completed_7d, got[1].items_7d, got[1].failures_in_a_row, got[1].last_success) == (3, 1, 7, 3, at(days=2))
    assert got[2].running_seconds == 1200
    assert (got[3].failed_24h, got[3].last_status, got[3].failures_in_a_row) == (0, None, 0)


def test_streak_bounded(spark):
    rows = spark.createDataFrame([(1, i, "failed") for i in range(15)], "source_id long, n long, status string")
    failed = F.col("status") == "failed"
    assert health.leading_streak(rows, "source_id", failed, ["n"]).first().streak == 15
    assert health.leading_streak(rows, "source_id", failed, ["n"], most=10).first().streak == 10


def test_dispatch(spark):
    """A pending run is active; retries use the batch up; skipped sources do, too."""
    ago = lambda **k: NOW - timedelta(**k)
    rows = [(1, True, True, True, NOW), (2, True, True, True, NOW + timedelta(1)), (3, False, True, True, NOW), (4, True, False, True, NOW), (5, True, True, False, NOW), (6, True, True, True, ago(days=1)), (7, True, True, True, ago(hours=1)), (8, True, True, True, NOW), (9, True, True, True, ago(hours=2)), (10, True, True, True, None)]
    sources = spark.createDataFrame(rows, "source_id long, enabled boolean, automatic boolean, has_config boolean, next_at timestamp_ntz")
    runs = [(70, 7, "pending", ago(minutes=1), None), (80, 20, "pending", ago(minutes=2), None), (90, 9, "running", ago(hours=8), ago(hours=6, minutes=6)), (91, 21, "running", ago(hours=8), ago(hours=6, minutes=4)), (92, 6, "failed", ago(hours=9), ago(hours=9))]
    runs = spark.createDataFrame(runs, "run_id long, source_id long, status string, queued_at timestamp_ntz, started_at timestamp_ntz")
    now = F.lit(NOW).cast("timestamp_ntz")
    got = {(r.source_id, r.run_id, r.action) for r in health.dispatch(sources, runs, now, 10).collect()}
    assert got == {(9, 90, "close"), (20, 80, "retry"), (6, None, "start"), (9, None, "start"), (7, None, "active_run"), (1, None, "start"), (8, None, "start")}
    got = {(r.source_id, r.action) for r in health.dispatch(sources, runs, now, 3).collect() if r.run_id is None}
    assert got == {(6, "start"), (9, "start")}  # one place went to the retry
    assert {r.action for r in health.dispatch(sources, runs.where("false"), now, 10).collect()} == {"start"}


def upserted(spark, rows, current=(), stopped=()):
    schema = "k string, source string, url string, title string, page int, ts timestamp_ntz, n long, good boolean"
    batch = spark.createDataFrame([(k, "s", "u", t, p, NOW + timedelta(hours=9 * i), i, g) for i, (k, t, p, g) in enumerate(rows)], schema)
    have = spark.createDataFrame([(k, "s", "u", t, p, 5, NOW, NOW, NOW) for k, t, p in current], "k string, source string, url string, title string, page int, revision long, first_seen timestamp_ntz, last_seen timestamp_ntz, changed_at timestamp_ntz")
    stop = spark.createDataFrame([(x,) for x in stopped], "k string")
    out, after = linkage.upsert(have, batch, ["k", "source", "url"], ["title"], "ts", "n", stop, F.col("good"), page="page")
    return [(r.outcome, ",".join(r.changed), r.revision) for r in out.orderBy("n").collect()], {r.k: (r.title, r.page, r.revision) for r in after.collect()}


def test_rows_of_a_batch_see_each_other(spark):
    out, after = upserted(spark, [("x", "a", None, True), ("x", "a", None, True), ("x", "b", None, True)])
    assert out == [("created", "", 1), ("unchanged", "", 1), ("updated", "title", 2)] and after == {"x": ("b", None, 2)}
    # Refused and suppressed rows leave no trace; a smaller page is a change; null and empty are equal.
    rows = [("x", "c", 1, False), ("x", "a", 3, True), ("z", "q", 1, True), ("x", "a", 2, True), ("x", None, 4, True), ("x", "", None, True), ("x", "a", 2, None), ("w", None, 1, True), ("w", "", 1, True)]
    out, after = upserted(spark, rows, [("x", "a", 3), ("y", "y", 1)], ["z"])
    assert out == [("rejected", "", None), ("unchanged", "", 5), ("suppressed", "", None), ("updated", "page", 6), ("updated", "title", 7), ("unchanged", "", 7), ("rejected", "", None), ("created", "", 1), ("unchanged", "", 1)]
    assert after == {"x": (None, 2, 7), "y": ("y", 1, 5), "w": (None, 1, 1)}


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, "h1", "t"), (2, "h1", "u"), (3, "h2", "t"), (4, None, None), (5, None, None)], "id long, h string, t string")
    got = {tuple(r) for r in linkage.duplicate_links(rows, "id", [F.col("h"), F.col("t")]).collect()}
    assert got == {(1, 2), (1, 3)}


def test_changes(spark):
    rows = spark.createDataFrame([(1, 1, "a", ""), (1, 2, "a", None), (1, 3, "b", "x"), (2, 1, "a", "")], "k long, n long, title string, body string")
    got = [(r.n, r.changed, r.revision) for r in linkage.changed_fields(rows, "k", ["n"], ["title", "body"]).collect()]
    assert got == [(3, ["title", "body"], 2)]


def test_partial_batch_retires_nothing(spark):
    have = spark.createDataFrame([(1, "a"), (2, "a")], "k long, m string")
    come = spark.createDataFrame([(1, "b"), (2, "b")], "k long, m string")
    done = spark.createDataFrame([(1, True), (2, False)], "k long, complete boolean")
    got = {(r.k, r.m): (r.outcome, r.current) for r in linkage.media_reconcile(have, come, done, "k", "m").collect()}
    assert got == {(1, "a"): ("retired", False), (1, "b"): ("inserted", True), (2, "a"): ("kept", True), (2, "b"): ("inserted", True)}


def test_alerts(spark):
    rows = [("s", NOW + timedelta(hours=h), e) for h, e in enumerate([1, 1, 1, 0, 1, 1])]
    got = health.alerts(spark.createDataFrame(rows, "k string, at timestamp_ntz, e int"), "k", "at", F.col("e") > 0, 3600, 3 * 3600).collect()
    assert [(r.since, r.until) for r in got] == [(NOW, NOW + timedelta(hours=3))]


def test_counter_restart(spark):
    rows = spark.createDataFrame([("k", NOW + timedelta(hours=20 * i), i, c) for i, c in enumerate([5, 9, None, 2, 2])], "k string, ts timestamp_ntz, n long, c long")
    assert [r.gain for r in series.increase(rows, "k", "ts", "n", "c").orderBy("ts").collect()] == [0, 4, 0, 2, 0]


def test_an_infinite_bucket_gives_the_bound_below(spark):
    rows = spark.createDataFrame([("k", 1.0, 2), ("k", 5.0, 4), ("k", float("inf"), 10)], "k string, le double, n long")
    assert [series.bucket_quantile(rows, ["k"], "le", "n", q, "q").first().q for q in (0.2, 0.3, 0.9)] == [1.0, 3.0, 5.0]


PAGE = """<html><head><title>Ads</title><style>x{}</style></head><body><div id=list><a class="ad" href="/1">One</a><a class="ad hot" href="/2"> Two<br>lines </a><a href="/3"></a></div>
<table><tr><th>Eta</th><td>26</td></tr><tr><th>Tipo</th><td>Privato</td></tr><tr><th>Eta</th><td>99</td></tr></table>
<ul><li><b>Ada</b><i data-r="5"></i></li><li><b>Lin</b></li><li></li></ul></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>open <b>x")], "page_id long, html string")
    got = {(r.page_id, r.ordinal): r.value for r in html.values(pages, "#list a.ad", "href").collect()}
    assert got == {(1, 0): "/1", (1, 1): "/2"}
    assert [r.value for r in html.values(pages, "a").orderBy("ordinal").collect()] == ["One", "Two\nlines"]
    assert {r.key: r.value for r in html.pairs(pages, "tr", "th", "td").collect()} == {"Eta": "26", "Tipo": "Privato"}
    assert [r["item"] for r in html.items(pages, "li", "author=b@text;rating=i@data-r").orderBy("ordinal").collect()] == [{"author": "Ada", "rating": "5"}, {"author": "Lin"}]


def test_empty_tables(spark):
    none = spark.createDataFrame([], OCC)
    assert records.canonical(none).count() == records.overview(none).count() == records.canonical_history(none).count() == 0


def test_numbers_go_on_from_day_to_day(spark):
    rows = [("k", NOW + timedelta(hours=7 * i), i) for i in range(12)] + [("l", NOW, 0)]
    got = health.numbered(spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long"), "k", "ts", "i").collect()
    assert {(r.k, r.i, r.attempt, r.total) for r in got} == {("k", i, i + 1, 12) for i in range(12)} | {("l", 0, 1, 1)}


def test_streak_without_a_miss_or_a_hit(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, True), (2, 2, False)], "k long, n long, hit boolean")
    assert {r.k: r.streak for r in health.leading_streak(rows, "k", F.col("hit"), ["n"]).collect()} == {1: 2, 2: 0}


def test_unsupported_selectors_are_errors():
    root = html.parse('<div class="x"><p><a rel="next" href="u">t</a></p></div>')
    for selector in ("a:first-child", "a,p", "> a", "a >", "a ~ b", "a[rel^=n]", ""):
        with pytest.raises(ValueError, match="not supported"):
            html.select(root, selector)
    assert [e.tag for s in ("div a", "*", "a[href]", ".x", "div.x p") for e in html.select(root, s)] == ["a", "div", "p", "a", "a", "div", "p"]


def test_implied_ends_and_deep_pages(spark):
    """Left-out end tags end as parsers end them; a page of any depth is read without recursion."""
    texts = lambda page, selector: [html.element_text(e) for e in html.select(html.parse(page), selector)]
    assert texts("<p>a<p>b<div>c</div>d", "p") == ["a", "b"]
    assert texts("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "li") == ["a b c".replace(" ", ""), "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><th>c<td><p>d<table><tr><td>e</table></table>", "tr") == ["ab", "cde", "e"]
    assert texts("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "dd") == ["v", "w"] and texts("<div></p></span>x</div>y", "div") == ["x"]
    deep = "<p>x" * 2000 + "<div>" * 5000 + "end" + "</b>" * 5000
    pages = spark.createDataFrame([(1, deep), (2, None)], "page_id long, html string")
    assert html.values(pages, "p").count() == 2000
    assert html.values(pages, "div").where("value = 'end'").count() == 5000
    spark.sql("SELECT 1")
    html.register(spark)
    assert spark.sql("SELECT v.* FROM VALUES ('<i>a</i><i>b</i>') AS t(h), LATERAL extract_values(t.h, 'i', 'text') v").collect() == [(0, "a"), (1, "b")]


def test_quantiles(spark):
    quarter = series.quantiles(spark.createDataFrame([("a", x) for x in [1.0, 1.0, 2.0, 10.0, None]], "k string, v double"), ["k"], "v", p0=0.0, p50=0.5, p90=0.9, p100=1.0).first()
    assert tuple(quarter) == ("a", 1.0, 1.5, 7.6, 10.0)


def test_orphans_have_a_day_of_grace(spark):
    listing = spark.createDataFrame([("a", NOW - timedelta(2)), ("b", NOW - timedelta(2)), ("c", NOW - timedelta(hours=23)), ("d", None)], "k string, at timestamp_ntz")
    refs = spark.createDataFrame([("b", None)], "x string, y string")
    assert [r.k for r in linkage.unreferenced(listing, "k", refs, "at", F.lit(NOW).cast("timestamp_ntz")).collect()] == ["a"]


def test_merged_pages(spark):
    rows = spark.createDataFrame([("x", p, i, v) for p, page in enumerate([["a", "b"], ["b", "c"], ["d"]]) for i, v in enumerate(page)] + [("y", 0, 0, "a"), ("y", 1, 0, "a")], "k string, page int, i int, v string")
    got = {r.k: (r["values"], r.limit_reached) for r in linkage.merged_pages(rows, "k", ["page", "i"], F.col("v"), F.upper("v"), 3).collect()}
    assert got == {"x": (["A", "B", "C"], True), "y": (["A"], False)}


def test_detections(spark):
    rows = [(1, "FEMALE_BREAST_EXPOSED", 0.3), (1, "ANUS_EXPOSED", 0.7), (1, "FACE_MALE", 0.5), (2, "FEET_COVERED", 0.9), (3, "BUTTOCKS_EXPOSED", 0.2), (4, "FACE_MALE", None)]
    s = records.detection_scores(spark.createDataFrame(rows, "m int, c string, s double"), "m", "c", "s")
    got = {r.m: (r.explicit, r["class"], r.confidence, r.review) for r in s.select("m", "explicit", *records.media_class(F.col("explicit"), F.col("face"))).collect()}
    assert got == {1: (0.7, "explicit", 0.7, True), 2: (0.0, "safe", 1.0, False), 3: (0.2, "unclassified", 0.2, True), 4: (0.0, "safe", 1.0, False)}


def test_suppression_is_there_before_rows_go(spark):
    keys = spark.createDataFrame([(1, "h1"), (2, "h2")], "id int, h string")
    listed = spark.createDataFrame([("h2", 4, "old")], "key_hash string, blocked long, reason string")
    rows = spark.createDataFrame([(1, "a"), (3, "b")], "k int, v string")
    suppressed, left = records.erasure(keys, F.col("h"), listed, {"t": (rows, "k")})
    assert {tuple(r) for r in suppressed.collect()} == {("h1", 0, "erasure"), ("h2", 4, "old")} and [r.v for r in left["t"].collect()] == ["b"]


def test_pages_are_freed_one_by_one_and_handed_on_in_small_batches(spark):
    import gc
    import weakref

    roots, parse = [], html.parse
    gc.disable()
    try:
        html.parse = lambda x: (r := parse(x), roots.append(weakref.ref(r)))[0]
        assert html._read_page("<ul><li>a<li><b>c</b></ul>", [html.Values("li")]) == [["a", "c"]]
        assert [r() for r in roots] == [None]
    finally:
        html.parse = parse
        gc.enable()
    n = 2 * html.PAGES + 3
    pages = spark.range(n).selectExpr("id AS page_id", "concat('<p>', id, '</p>') AS html").coalesce(1)
    assert {r.page_id: r.v for r in html.read_fields(pages, v=html.Values("p")).collect()} == {i: [str(i)] for i in range(n)}
