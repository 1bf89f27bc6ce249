"""Deduplication, upserts, reconciliation and scoped exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import set_hash
from ..functions.text import normal_text, normal_url
from ..operators import linkage
from ..sources.tables import classify_entries, manifest, merge_entries, table
from .registry import query, url_key


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS size, min(doc_id) AS first_id FROM documents GROUP BY 1")
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by content hash (O8.1, O9.10)."""
    return linkage.dedup_by_hash(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query(f"""WITH p AS (SELECT page_id, html, url, lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))) AS title, lower(trim(regexp_replace(regexp_extract(html, '<article>([\\s\\S]*)</article>', 1), '\\s+', ' ', 'g'))) AS description FROM pages),
k AS (SELECT page_id, sha256(html) AS a, CASE WHEN url <> '' THEN {url_key("url")} END AS b, CASE WHEN title <> '' THEN md5(title) || md5(description) END AS c FROM p),
g AS (SELECT min(page_id) OVER (PARTITION BY a) AS low, page_id AS id FROM k WHERE a IS NOT NULL UNION SELECT min(page_id) OVER (PARTITION BY b), page_id FROM k WHERE b IS NOT NULL UNION SELECT min(page_id) OVER (PARTITION BY c), page_id FROM k WHERE c IS NOT NULL)
SELECT low, id FROM g WHERE low <> id""")
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of equal hash, of equal address, or of equal title and description where there is a title, linked to the first of them (O9.14)."""
    inside = lambda tag, what: normal_text(F.regexp_extract("html", f"<{tag}>({what})</{tag}>", 1))
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html", inside("title", "[^<]*").alias("title"), inside("article", r"[\s\S]*").alias("description"))
    keys = [F.sha2("html", 256), F.when(F.col("url") != "", normal_url(F.col("url"))), F.when(F.col("title") != "", F.concat(F.md5("title"), F.md5("description")))]
    return linkage.duplicate_links(p, "page_id", keys)


@query("""WITH k AS (SELECT doc_id, sha256(text) AS a, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' THEN md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) END AS b FROM documents),
g AS (SELECT min(doc_id) OVER (PARTITION BY a) AS low, doc_id AS id FROM k WHERE a IS NOT NULL UNION SELECT min(doc_id) OVER (PARTITION BY b), doc_id FROM k WHERE b IS NOT NULL)
SELECT low, id FROM g WHERE low <> id""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of equal hash, or of equal normalised whole texts (title and description), linked to the first of them (O9.9, O9.14)."""
    whole = normal_text(F.col("text"))
    keys = [F.sha2("text", 256), F.when(whole != "", F.md5(whole))]
    return linkage.duplicate_links(table(spark, sf_dir, "documents"), "doc_id", keys)


_ADS = """o AS (SELECT o_orderkey, o_custkey AS record_id, o_orderstatus AS source, 'https://a.example/' || o_custkey AS url, o_orderpriority AS title, CASE WHEN o_totalprice < 120000 THEN NULL WHEN o_totalprice < 200000 THEN '' ELSE 'x' END AS description,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 + 1 AS INTEGER) END AS page, o_totalprice, o_orderdate AS ts FROM orders),
old AS (SELECT record_id, source, url, arg_max(title, (ts, o_orderkey)) AS title, arg_max(coalesce(description, 'null'), (ts, o_orderkey)) AS d, min(page) AS page, count(*) AS revision, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) AS changed_at FROM o WHERE ts < TIMESTAMP '1997-01-01' GROUP BY 1, 2, 3),
cur AS (SELECT * EXCLUDE (d), nullif(d, 'null') AS description FROM old),
inc AS (SELECT *, CASE WHEN o_totalprice < 30000 THEN 'rejected' WHEN record_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500) THEN 'suppressed' END AS refused FROM o WHERE ts >= TIMESTAMP '1997-01-01'),
acc AS (SELECT i.*, c.record_id IS NULL AND row_number() OVER w = 1 AS fresh, coalesce(c.revision, 0) AS base, CASE WHEN row_number() OVER w = 1 THEN c.title ELSE lag(i.title) OVER w END AS was_title,
  CASE WHEN row_number() OVER w = 1 THEN c.description ELSE lag(i.description) OVER w END AS was_description, least(c.page, min(i.page) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS was_page
  FROM (FROM inc WHERE refused IS NULL) i LEFT JOIN cur c USING (record_id, source, url) WINDOW w AS (PARTITION BY i.record_id, i.source, i.url ORDER BY i.ts, i.o_orderkey)),
chg AS (SELECT *, CASE WHEN fresh THEN [] ELSE list_filter([CASE WHEN title <> was_title THEN 'title' END, CASE WHEN coalesce(description, '') <> coalesce(was_description, '') THEN 'description' END,
  CASE WHEN page IS NOT NULL AND (was_page IS NULL OR page < was_page) THEN 'page' END], lambda x: x IS NOT NULL) END AS changed FROM acc),
res AS (SELECT *, CASE WHEN fresh THEN 'created' WHEN len(changed) > 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM chg),
num AS (SELECT *, base + count(*) FILTER (WHERE outcome <> 'unchanged') OVER (PARTITION BY record_id, source, url ORDER BY ts, o_orderkey ROWS UNBOUNDED PRECEDING) AS revision FROM res)"""


def _upsert(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as adverts of records at sources: those of 1997 and later meet the ones before."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("record_id"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("https://a.example/"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("title"),
        F.when(price >= 200000, "x").when(price >= 120000, "").alias("description"), F.when(k % 5 != 0, k % 7 + 1).cast("int").alias("page"), "o_totalprice", F.col("o_orderdate").alias("ts"),
    )
    key, split = ["record_id", "source", "url"], F.lit("1997-01-01").cast("timestamp_ntz")
    last = F.max_by(F.struct("title", "description"), F.struct("ts", "o_orderkey")).alias("last")
    times = [F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("ts").alias("changed_at")]
    current = o.where(F.col("ts") < split).groupBy(*key).agg(last, F.min("page").alias("page"), F.count("*").alias("revision"), *times).select(*key, "last.*", "page", "revision", "first_seen", "last_seen", "changed_at")
    stopped = table(spark, sf_dir, "customer").where("c_acctbal < -500").select("c_custkey")
    return linkage.upsert(current, o.where(F.col("ts") >= split), key, ["title", "description"], "ts", "o_orderkey", stopped, price >= 30000, page="page", bucket="month")


@query(f"""WITH {_ADS} SELECT o_orderkey, record_id, refused AS outcome, '' AS changed, NULL::BIGINT AS revision FROM inc WHERE refused IS NOT NULL
UNION ALL SELECT o_orderkey, record_id, outcome, array_to_string(changed, ','), revision FROM num""")
def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert of later orders does with each of them, beside the last accepted one before it, in the batch or stored (O8.2)."""
    out, _ = _upsert(spark, sf_dir)
    return out.select("o_orderkey", "record_id", "outcome", F.array_join("changed", ",").alias("changed"), "revision")


@query(f"""WITH {_ADS}, new AS (SELECT record_id, source, url, arg_max(title, (ts, o_orderkey)) FILTER (WHERE outcome <> 'unchanged') AS title, arg_max(coalesce(description, 'null'), (ts, o_orderkey)) FILTER (WHERE outcome <> 'unchanged') AS d, bool_or(outcome <> 'unchanged') AS moved,
  min(page) AS page, max(revision) AS revision, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) FILTER (WHERE outcome <> 'unchanged') AS changed_at FROM num GROUP BY 1, 2, 3)
SELECT record_id, source, url, CASE WHEN moved THEN n.title ELSE c.title END AS title, CASE WHEN moved THEN nullif(n.d, 'null') ELSE c.description END AS description, least(c.page, n.page) AS page, coalesce(n.revision, c.revision) AS revision,
  coalesce(c.first_seen, n.first_seen) AS first_seen, greatest(c.last_seen, n.last_seen) AS last_seen, greatest(c.changed_at, n.changed_at) AS changed_at FROM cur c FULL OUTER JOIN new n USING (record_id, source, url)""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adverts after that upsert (O8.2)."""
    return _upsert(spark, sf_dir)[1]


@query("""WITH e AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS item FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), i AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS item FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-06-01'),
j AS (SELECT coalesce(e.k, i.k) AS k, coalesce(e.item, i.item) AS item, e.k IS NOT NULL AS old, i.k IS NOT NULL AS new FROM e FULL OUTER JOIN i ON e.k = i.k AND e.item = i.item)
SELECT k AS part, item, CASE WHEN NOT old THEN 'inserted' WHEN new THEN 'refreshed' WHEN k % 2 = 0 THEN 'retired' ELSE 'kept' END AS outcome, NOT (old AND NOT new AND k % 2 = 0) AS current FROM j""")
def media_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which media are current after a complete or a partial batch (O8.4)."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("item"), "l_shipdate")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    complete = l.select("part").distinct().withColumn("complete", F.col("part") % 2 == 0)
    return linkage.media_reconcile(l.where(F.col("l_shipdate") < at("1998-01-01")), l.where(F.col("l_shipdate") >= at("1997-06-01")), complete, "part", "item")


@query("""WITH s AS (SELECT l_partkey AS part, '["' || string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '","' ORDER BY CAST(l_suppkey AS VARCHAR)) || '"]' AS j FROM lineitem GROUP BY 1)
SELECT part, sha256(j) AS media_hash, sha256(sha256(p_name) || ':' || sha256(j)) AS fingerprint FROM s JOIN part ON p_partkey = part""")
def media_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each part's set of media, whatever their order, and of content and media (O4.16, O9.11)."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(set_hash(F.collect_set(F.col("l_suppkey").cast("string"))).alias("media_hash"))  # a part's own suppliers
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.sha2("p_name", 256).alias("content"))
    return l.join(p, "part").select("part", "media_hash", F.sha2(F.concat_ws(":", "content", "media_hash"), 256).alias("fingerprint"))


@query("""WITH i AS (SELECT event_type || '-' || strftime(ts, '%Y%m%d%H') AS dedup_key, event_id FROM events), f AS (SELECT dedup_key, min(event_id) AS event_id FROM i GROUP BY 1)
SELECT dedup_key, event_id FROM f WHERE dedup_key NOT IN (SELECT event_type || '-' || strftime(ts, '%Y%m%d%H') FROM events WHERE ts < TIMESTAMP '2024-01-05')""")
def dedup_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first notification of each hour and kind that was not sent yet (O8.5, O10.7)."""
    key = F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMddHH"))
    e = table(spark, sf_dir, "events").select(key.alias("dedup_key"), "event_id", "ts")
    sent = e.where(F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz"))
    return linkage.insert_if_absent(sent, e, "dedup_key", "event_id").select("dedup_key", "event_id")


@query("""SELECT coalesce(a.s_suppkey, b.l_suppkey) AS key, CASE WHEN a.s_suppkey IS NULL THEN 'insert' WHEN b.l_suppkey IS NULL THEN 'disable' ELSE 'refresh' END AS outcome
FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) a FULL OUTER JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01') b ON a.s_suppkey = b.l_suppkey""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing against incoming keys (O7.4)."""
    have = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("key"))
    come = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select(F.col("l_suppkey").alias("key"))
    return linkage.reconcile(have, come, "key")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    e = s.where("s_suppkey % 2 = 0").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    slug = F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("s_suppkey") % 90).cast("string")))
    return e.select("s_suppkey", slug.alias("slug"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 == 0, F.col("n_name")).alias("poolName"))


_ENTRIES = """ent AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 's' || CAST(s_suppkey % 90 AS VARCHAR) END AS slug, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN n_name END AS "poolName"
  FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0),
known AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS slug, s_acctbal > 0 AS enabled, s_name AS name FROM supplier WHERE s_suppkey < 30)"""


@query(f"""WITH {_ENTRIES} SELECT s_suppkey, slug, name, "poolName", CASE WHEN slug = '' OR trim(name) = '' OR count(*) OVER (PARTITION BY slug) > 1 THEN 'invalid' WHEN slug IN (SELECT slug FROM known) THEN 'conflict' ELSE 'new' END AS status,
  CASE WHEN "poolName" IS NULL THEN 'none' WHEN "poolName" IN (SELECT n_name FROM nation WHERE n_regionkey < 3) THEN 'resolved' ELSE 'missing' END AS pool_status FROM ent""")
def import_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an import by what they would do (O1.9)."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey < 30").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"))
    pools = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("name"))
    return classify_entries(_entries(spark, sf_dir), known, pools)


@query(f"""WITH {_ENTRIES}, one AS (SELECT slug, min(name) AS name FROM ent WHERE slug <> '' GROUP BY 1)
SELECT coalesce(o.slug, k.slug) AS slug, coalesce(o.name, k.name) AS name, coalesce(k.enabled, false) AS enabled, CASE WHEN k.slug IS NULL THEN 'created' WHEN o.slug IS NULL THEN 'kept' ELSE 'overwritten' END AS outcome FROM known k FULL OUTER JOIN one o ON o.slug = k.slug""")
def merge_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of an import: incoming values win, new rows arrive disabled (O1.10)."""
    one = _entries(spark, sf_dir).where("slug <> ''").groupBy("slug").agg(F.min("name").alias("name"))
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    known = table(spark, sf_dir, "supplier").where("s_suppkey < 30").select(key.alias("slug"), (F.col("s_acctbal") > 0).alias("enabled"), F.col("s_name").alias("name"))
    return merge_entries(one, known, "slug", ["name"])


@query("""SELECT n_name AS name, to_json({'name': n_name, 'pool': r_name}) AS entry FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3""")
def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an export, pool names looked up (O1.11, O10.15)."""
    pools = table(spark, sf_dir, "region").where("r_regionkey < 3")
    n = table(spark, sf_dir, "nation").join(pools, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.select(F.col("n_name").alias("name"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("pool")), {"ignoreNullFields": "false"}).alias("entry"))


_STOPPED = "SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"


def _stopped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents by the hash of their text, and the hashes of those that are labelled toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("k"))
    return d, d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("k").distinct()


@query(f"""SELECT d.doc_id, d.source FROM documents d WHERE sha256(d.text) NOT IN ({_STOPPED})""")
def suppression_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not suppressed: no text that is labelled toxic anywhere (O3.11)."""
    d, stopped = _stopped(spark, sf_dir)
    return d.join(stopped, "k", "left_anti").select("doc_id", "source")


@query(f"""SELECT sha256(text) AS k, count(*) AS hits FROM documents WHERE sha256(text) IN ({_STOPPED}) GROUP BY 1""")
def suppression_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each suppressed key comes (O3.11)."""
    d, stopped = _stopped(spark, sf_dir)
    return d.join(stopped, "k", "left_semi").groupBy("k").agg(F.count("*").alias("hits"))


@query("""SELECT 'job-1' AS job_id, coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL OR l.doc_id IS NULL THEN 'missing' WHEN toxic = 0 AND quality = 1 THEN 'exported' ELSE 'withheld' END AS outcome FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id""")
def safe_export_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen scope of all documents: what is safe goes, the rest is withheld, and ids of which one side doesn't exist are told (O2.7, O8.6)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("there"))
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("known"))
    outcome = F.when(F.col("known").isNull() | F.col("there").isNull(), "missing").when((F.col("toxic") == 0) & (F.col("quality") == 1), "exported")
    return d.join(l, "doc_id", "full_outer").select(F.lit("job-1").alias("job_id"), "doc_id", outcome.otherwise("withheld").alias("outcome"))


@query("""SELECT source, count(*) AS rows, CAST(sum(octet_length(encode(line))) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(sha256(line), 1, 8) AS BIGINT)) AS BIGINT) AS checksum
FROM (SELECT source, CAST(doc_id AS VARCHAR) || ',' || lang || ',' || text AS line FROM documents) GROUP BY 1""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes and checksum of each export file (O1.14, O4.6)."""
    line = F.concat_ws(",", F.col("doc_id").cast("string"), "lang", "text")
    return manifest(table(spark, sf_dir, "documents"), "source", line)


@query("""SELECT source, count(*) AS documents, coalesce(sum(n_chars) FILTER (WHERE quality = 1 AND toxic = 0), 0) AS total, coalesce(sum(n_chars) FILTER (WHERE toxic = 1), 0) AS withheld FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def export_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of each source's safe documents would hold; a sum over nothing is zero (O4.6)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n_chars"))), F.lit(0))
    return d.groupBy("source").agg(F.count("*").alias("documents"), total((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("total"), total(F.col("toxic") == 1).alias("withheld"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' - INTERVAL 24 HOUR AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')""")
def orphan_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects that no column of a table refers to and that were written more than a day ago (O1.17, O7.3)."""
    refs = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("a"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("b"))
    now = F.lit("1998-07-01").cast("timestamp_ntz")
    return linkage.unreferenced(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", refs, "o_orderdate", now).select("o_orderkey")
