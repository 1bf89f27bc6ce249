"""Extraction from pages, and classification by thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.text import defragment, origin, resolve_url
from ..operators import html, records
from ..operators import walk as walking
from ..sources.tables import listing, table
from .registry import query


@query("""SELECT page_id, CAST(o - 1 AS INTEGER) AS ordinal, l[o] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS o FROM (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"]*)"', 1) AS l FROM pages))""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page in order (O1.3, O11.1)."""
    p = table(spark, sf_dir, "pages").select("page_id", html.tag_values(F.col("html"), "a", "href").alias("l"))
    return p.select("page_id", F.posexplode("l").alias("ordinal", "href"))


@query("""SELECT href, min(page_id) AS first_page, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links with the lowest page that has them (O1.3)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(html.tag_values(F.col("html"), "a", "href")).alias("href"))
    return p.groupBy("href").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"]*)"', 1)) AS href FROM pages), h AS (SELECT *, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS host FROM l)
SELECT page_id, href, regexp_replace(CASE WHEN href LIKE '/%' THEN host || href WHEN href LIKE 'http%' THEN href ELSE 'odd' END, '#.*$', '') AS target, href LIKE '/%' OR starts_with(href, host || '/') AS same_origin FROM h""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as full addresses without fragments, and whether they stay at their page's origin (O1.3, O9.8)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(html.tag_values(F.col("html"), "a", "href")).alias("href"))
    target = defragment(resolve_url(F.col("url"), F.col("href")))
    return p.select("page_id", "href", target.alias("target"), (origin(F.col("url")) == origin(target)).alias("same_origin"))


_SITE = """p AS (SELECT page_id, (SELECT count(*) FROM pages) AS n, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)">', 1) AS ads, length(html) AS size FROM pages),
q AS (SELECT page_id, 'https://s' || (page_id % 2) || '.example/p/' || page_id AS url, list_filter(ads, lambda x: trim(x) <> '') AS ads, (page_id * 7 + size) % n AS k, size % 9 AS kind FROM p),
l AS (SELECT url, page_id, ads, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS controls, CASE kind WHEN 0 THEN [] WHEN 1 THEN ['https://s' || (k % 2) || '.example/p/' || k, '/p/x'] WHEN 2 THEN ['https://s' || (k % 2) || '.example/p/' || k || '#a', 'https://s' || (k % 2) || '.example/p/' || k] WHEN 3 THEN [] ELSE ['https://s' || (page_id % 2) || '.example/p/' || (k - k % 2 + page_id % 2) || '#top'] END AS nexts FROM q),
w AS (SELECT page_id % 20 AS source_id, page_id AS start_no, url AS start_url, url AS pg, 0 AS step, CAST([] AS VARCHAR[]) AS seen, CASE WHEN controls = 0 THEN 'end_of_pagination' ELSE '' END AS reason FROM l UNION ALL
  SELECT source_id, start_no, start_url, nxt, step + 1, list_append(seen, pg), CASE WHEN list_contains(list_append(seen, pg), nxt) THEN 'repeated_page' WHEN t.url IS NULL THEN 'fetch_failed' WHEN step + 2 >= 5 THEN 'max_pages' WHEN t.controls = 0 THEN 'end_of_pagination' ELSE '' END
  FROM (SELECT w.*, split_part(l.nexts[1], '#', 1) AS nxt, l.controls, l.nexts FROM w JOIN l ON l.url = w.pg WHERE reason = '') x LEFT JOIN l t ON t.url = nxt
  WHERE len(x.nexts) = x.controls AND len(list_distinct(list_transform(x.nexts, lambda y: split_part(y, '#', 1)))) = 1 AND split_part(start_url, '/', 3) = split_part(nxt, '/', 3)),
v AS (SELECT w.*, CASE WHEN reason <> '' THEN reason WHEN len(nexts) <> controls THEN 'click_requires_browser' WHEN len(list_distinct(list_transform(nexts, lambda y: split_part(y, '#', 1)))) > 1 THEN 'ambiguous_next_control' WHEN split_part(start_url, '/', 3) <> split_part(nexts[1], '/', 3) THEN 'cross_origin_blocked' ELSE '' END AS stop
  FROM w LEFT JOIN l ON l.url = w.pg),
f AS (SELECT source_id, start_no, step, o AS place, CASE WHEN a LIKE '/%' THEN regexp_extract(pg, '^https://[^/]*') || a ELSE a END AS url FROM (SELECT v.*, unnest(ads) AS a, unnest(range(len(ads))) AS o FROM v JOIN l ON l.url = v.pg WHERE stop NOT IN ('repeated_page', 'fetch_failed'))),
o AS (SELECT source_id, url, row_number() OVER (PARTITION BY source_id ORDER BY min((start_no, step, place))) AS ordinal, min((start_no, step, place)) AS spot FROM f GROUP BY 1, 2),
c AS (SELECT source_id, spot AS cut FROM o WHERE ordinal = 60)"""


def _walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every page as the start of a walk for one of twenty sources; Next links follow from a page's size."""
    p = table(spark, sf_dir, "pages")
    n, size = p.count(), F.length("html")
    k = (F.col("page_id") * 7 + size) % n
    address = lambda site, page: F.concat(F.lit("https://s"), (site % 2).cast("string"), F.lit(".example/p/"), page.cast("string"))
    url, other, own, kind = address(F.col("page_id"), F.col("page_id")), address(k, k), address(F.col("page_id"), k - k % 2 + F.col("page_id") % 2), size % 9
    link = lambda href: F.concat(F.lit('<a class="next" href="'), href, F.lit('">Next</a>'))
    control = (
        F.when(kind == 0, "").when(kind == 1, F.concat(link(other), link(F.lit("/p/x")))).when(kind == 2, F.concat(link(F.concat(other, F.lit("#a"))), link(other))).when(kind == 3, '<a class="next">Next</a>')
        .otherwise(link(F.concat(F.element_at(F.split(own, "example"), 2), F.lit("#top"))))
    )
    site = p.select("page_id", url.alias("url"), F.concat("html", control).alias("html"))
    links = walking.listing_links(site, "url", "html", "//nav//a[@href]", "a.next")
    starts = site.select((F.col("page_id") % 20).alias("source_id"), F.col("page_id").alias("start_no"), F.col("url").alias("start_url"))
    return walking.walk(starts, links, max_pages=5, max_ads=60)


@query(f"""WITH RECURSIVE {_SITE} SELECT source_id, start_no, count(*) FILTER (WHERE stop NOT IN ('repeated_page', 'fetch_failed')) AS pages_visited, arg_max(CASE WHEN (start_no, step) = (cut[1], cut[2]) THEN 'max_ads' ELSE nullif(stop, '') END, step) AS stop_reason
FROM (SELECT v.*, c.cut FROM v LEFT JOIN c USING (source_id)) WHERE cut IS NULL OR (start_no, step) <= (cut[1], cut[2]) GROUP BY 1, 2""")
def listing_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that each start visits and why it stops (O1.3)."""
    return _walk(spark, sf_dir)[0]


@query(f"""WITH RECURSIVE {_SITE} SELECT source_id, url, CAST(ordinal AS INTEGER) AS ordinal, CAST(min(step) + 1 AS INTEGER) AS page_number FROM (SELECT f.*, o.ordinal FROM f JOIN o USING (source_id, url) LEFT JOIN c USING (source_id) WHERE ordinal <= 60 AND (cut IS NULL OR (start_no, step, place) <= cut)) GROUP BY 1, 2, 3""")
def listing_adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adverts that each source's walks find, in their order, and the first page of each (O1.3, O1.6, O11.1)."""
    return _walk(spark, sf_dir)[1]


@query("""WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href="([^"]*)">', 1) AS x, regexp_extract_all(html, '<p\\b') AS p FROM pages)
SELECT page_id, list_filter([trim(x[2])], lambda y: y <> '') AS second, list_filter([trim(x[len(x)])], lambda y: y <> '') AS last, CAST(len(list_filter(x, lambda y: contains(y, 'a'))) AS INTEGER) AS with_a FROM l""")
def html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page's menu by place and by what they hold, selected by XPath (O11.1)."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return html.read_fields(p, second=html.Values("//nav/ul/li[2]/a", "href"), last=html.Values("//nav//li[last()]/a/@href"), with_a=html.Count("//nav//li[a[contains(@href, 'a')]]"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as visible text (O1.5, O11.3); no SQL reads real HTML, a test holds it against a plain reader."""
    return html.values(table(spark, sf_dir, "pages"), "p")


@query("""WITH l AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages), v AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)">', 1) AS x FROM l)
SELECT page_id, CAST(o - 1 AS INTEGER) AS ordinal, trim(x[o]) AS value FROM (SELECT page_id, list_filter(x, lambda y: trim(y) <> '') AS x, unnest(range(1, len(list_filter(x, lambda y: trim(y) <> '')) + 1)) AS o FROM v)""")
def html_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute of the elements that a selector names (O11.2)."""
    return html.values(table(spark, sf_dir, "pages"), "nav a[href]", "href")


_NAV = r"""l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="[^"]*">[^<]*</a>') AS x FROM pages),
a AS (SELECT page_id, o, regexp_extract(x[o], 'href="([^"]*)"', 1) AS href, trim(regexp_extract(x[o], '>([^<]*)<', 1)) AS label FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS o FROM l))"""


@query(f"WITH {_NAV} SELECT page_id, label AS key, arg_min(label, o) AS value FROM a WHERE label <> '' GROUP BY 1, 2")
def html_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value of each entry of a list, the first one of a key (O11.5)."""
    return html.pairs(table(spark, sf_dir, "pages"), "nav li", "a", "a")


@query(f"""WITH {_NAV} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INTEGER) AS ordinal, nullif(href, '') AS poster, nullif(label, '') AS video FROM a WHERE href <> '' OR label <> ''""")
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values of each container, such as a film's poster and file (O11.6, O11.7)."""
    found = html.items(table(spark, sf_dir, "pages"), "nav li", "poster=a@href;video=a@text")
    return found.select("page_id", "ordinal", F.col("item")["poster"].alias("poster"), F.col("item")["video"].alias("video"))


@query(r"""SELECT page_id, url, t.title, len(regexp_extract_all(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<a href="')) AS links, len(regexp_extract_all(html, '<a href="')) = 0 AS no_links
FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;', '"', 'g'), '&(#39|#x27);', chr(39), 'g'), '&amp;', '&', 'g'), '\s+', ' ', 'g')) AS title FROM pages) t WHERE t.title <> ''""")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title and the links of each page, read in one pass, valid pages only (O1.6, O11.4, O11.7, O11.8, O11.10)."""
    pages = table(spark, sf_dir, "pages")
    found = html.read_fields(pages, titles=html.Values("title"), anchors=html.Items("a[href]", "href=@href;text=@text"))
    rows = pages.select("page_id", "url").join(found.select("page_id", F.get("titles", F.lit(0)).alias("title"), F.size("anchors").cast("long").alias("links")), "page_id")
    good, _ = html.split_valid(rows.withColumn("no_links", F.col("links") == 0), F.trim("title") != "")
    return good.select("page_id", "url", "title", "links", "no_links")


@query("""SELECT page_id, contains(lower(html), '<title>just a moment') AND contains(lower(html), '/cdn-cgi/challenge-platform/') AS challenge, trim(regexp_replace(lower(coalesce(html, '')), '<[^>]*>', '', 'g')) = '' AS empty FROM pages""")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-quality flags of pages as they are (O11.9)."""
    return table(spark, sf_dir, "pages").withColumns(html.page_flags(F.col("html"))).select("page_id", "challenge", "empty")


_ANSWERS = ("<title>Just a moment...</title>", "<title>Attention Required</title><div id=\"challenge-form\">", "<script src=/cdn-cgi/challenge-platform/x>", "<p>cf-chl-x</p>", "<title>Shop</title>", "")


@query(f"""WITH r AS (SELECT event_id, list_extract([{', '.join("'" + x + "'" for x in _ANSWERS)}], CAST(event_id % 6 AS INTEGER) + 1) AS html, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'error' THEN 403 ELSE 200 END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'CloudFlare' WHEN event_id % 5 = 1 THEN 'nginx' END AS server, CASE WHEN event_id % 11 = 0 THEN 'r' END AS ray FROM events),
m AS (SELECT *, contains(html, '/cdn-cgi/challenge-platform/') OR contains(html, 'cf-chl-') OR contains(html, 'id="challenge-form"') AS mark, starts_with(html, '<title>Just') OR starts_with(html, '<title>Att') AS title FROM r)
SELECT event_id, (coalesce(status, 0) = 403 AND (mark OR title OR coalesce(server, '') = 'CloudFlare' OR ray IS NOT NULL)) OR (mark AND title) AS challenge FROM m""")
def challenge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenge pages by text, status and headers (O11.9)."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        i, F.get(F.array(*map(F.lit, _ANSWERS)), (i % 6).cast("int")).alias("html"), F.when(i % 7 != 0, F.when(F.col("event_type") == "error", 403).otherwise(200)).alias("status"),
        F.when(i % 5 == 0, "CloudFlare").when(i % 5 == 1, "nginx").alias("server"), F.when(i % 11 == 0, "r").alias("ray"),
    )
    return e.withColumns(html.page_flags(F.col("html"), F.col("status"), F.col("server"), F.col("ray"))).select("event_id", "challenge")


@query("""WITH s AS (SELECT label AS media_id, vec_id AS frame, embedding[1] * 0 + (vec_id % 101) / 100.0::DOUBLE AS explicit, (vec_id % 37) / 36.0::DOUBLE AS face FROM embeddings),
m AS (SELECT media_id, max(explicit) AS explicit, arg_max(face, (explicit, frame)) AS face, arg_max(frame, (explicit, frame)) AS frame FROM s GROUP BY 1)
SELECT media_id, frame, CASE WHEN explicit >= 0.65 THEN 'explicit' WHEN explicit < 0.2 THEN 'safe' ELSE 'unclassified' END AS class, (explicit >= 0.2 AND explicit < 0.65) OR (explicit >= 0.65 AND face >= 0.5) AS review FROM m""")
def classify_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest frame of each medium, its class and whether someone must look (O4.17, O11.11)."""
    i = F.col("vec_id")
    s = table(spark, sf_dir, "embeddings").select(F.col("label").alias("media_id"), i.alias("frame"), ((i % 101) / 100.0).alias("explicit"), ((i % 37) / 36.0).alias("face"))
    m = s.groupBy("media_id").agg(F.max_by(F.struct("explicit", "face", "frame"), F.struct("explicit", "frame")).alias("m")).select("media_id", "m.*")
    name = F.when(F.col("explicit") >= 0.65, "explicit").when(F.col("explicit") < 0.2, "safe").otherwise("unclassified")
    m = m.withColumn("class", name)
    return m.select("media_id", "frame", "class", ((F.col("class") == "unclassified") | ((F.col("class") == "explicit") & (F.col("face") >= 0.5))).alias("review"))


_SEEN = """CASE l_returnflag WHEN 'R' THEN 'FEMALE_BREAST_EXPOSED' WHEN 'A' THEN 'FACE_FEMALE' ELSE CASE WHEN l_linestatus = 'O' THEN 'FACE_MALE' ELSE 'FEET_COVERED' END END"""


@query(f"""WITH d AS (SELECT l_orderkey AS media_id, {_SEEN} AS label, l_discount * 10 AS score FROM lineitem), s AS (SELECT media_id, coalesce(max(score) FILTER (WHERE label = 'FEMALE_BREAST_EXPOSED'), 0.0) AS explicit, coalesce(max(score) FILTER (WHERE label LIKE 'FACE%'), 0.0) AS face FROM d GROUP BY 1)
SELECT media_id, floor(explicit * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS explicit_score, floor(face * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS face_score, CASE WHEN explicit >= 0.65 THEN 'explicit' WHEN explicit < 0.2 THEN 'safe' ELSE 'unclassified' END AS class,
  floor(CASE WHEN explicit < 0.2 THEN 1.0 - explicit ELSE explicit END * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS confidence, CASE WHEN explicit >= 0.65 THEN face >= 0.5 ELSE explicit >= 0.2 END AS review FROM s""")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each medium's scores, the largest of its detections in each family of labels, and its class (O4.18, O11.11)."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.expr(_SEEN).alias("label"), (F.col("l_discount") * 10).alias("score"))
    s = records.detection_scores(d, "media_id", "label", "score")
    return s.select("media_id", half_up(F.col("explicit"), 6).alias("explicit_score"), half_up(F.col("face"), 6).alias("face_score"), *records.media_class(F.col("explicit"), F.col("face")))


@query()
def binary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects by name and size, their bytes unread (O1.16)."""
    return listing(spark, f"{sf_dir}/pages.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
