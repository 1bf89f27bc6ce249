"""Text, URL, time and JSON functions over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx, numbers, text
from ..operators import linkage, textindex
from ..sources.tables import dealt, scratch, table
from .registry import query, url_key


@query(f"""WITH q AS (SELECT page_id, {url_key("url")} AS url_key, regexp_extract(url, '^([^:/?#]+)://([^/?#]*)', ['scheme', 'host']) AS u FROM pages)
SELECT page_id, url_key, lower(u.scheme) || ':' || lower(split_part(u.host, ':', 1)) || ':' || CASE WHEN contains(u.host, ':') THEN split_part(u.host, ':', 2) WHEN lower(u.scheme) = 'https' THEN '443' ELSE '80' END AS origin FROM q""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable addresses and their origins (O9.7, O9.8)."""
    return table(spark, sf_dir, "pages").select("page_id", text.normal_url(F.col("url")).alias("url_key"), text.origin(F.col("url")).alias("origin"))


_TAILS = ("//?b=2&UTM_Source=x&a=1", "/?utm_medium=m&utm_campaign=c&utm_term=t&utm_content=c", "/a;p=1?gclid=1&fbclid=2&z=%7e*+%C3%A9", "?msclkid=1&referrer=r&ref=s&mc_cid=k#end", "/x;y/z///?q&=v&a=2&a=1&&b", " ")


@query(f"""WITH l AS (SELECT c_custkey, 'HTTPS://Shop-' || c_custkey || '.Example.COM' || tail AS url FROM customer, (SELECT unnest({list(_TAILS)}) AS tail)) SELECT c_custkey, url, {url_key("url")} AS url_key FROM l""")
def url_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up addresses with every tracking parameter, escapes, repeated and blank parameters (O9.7)."""
    tails = F.explode(F.array(*map(F.lit, _TAILS)))
    links = dealt(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", tails.alias("tail"))
    links = links.select("c_custkey", F.concat(F.lit("HTTPS://Shop-"), F.col("c_custkey").cast("string"), F.lit(".Example.COM"), "tail").alias("url"))
    return links.withColumn("url_key", text.normal_url(F.col("url")))


_PHONES = """phone AS (SELECT c_custkey, CASE CAST(c_custkey % 6 AS INTEGER) WHEN 0 THEN '+39 333 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') WHEN 1 THEN '0039-333-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
  WHEN 2 THEN '333 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') WHEN 3 THEN 'tel:+39(333)' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') WHEN 4 THEN 'not-a-phone' END AS raw FROM customer),
e164 AS (SELECT c_custkey, raw, CASE WHEN c_custkey % 6 < 4 THEN '+39333' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS phone FROM phone)"""


def _phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    digits = F.lpad(k.cast("string"), 7, "0")
    form = lambda x: F.concat(F.lit(x), digits)
    raw = F.when(k % 6 == 0, form("+39 333 ")).when(k % 6 == 1, form("0039-333-")).when(k % 6 == 2, form("333 ")).when(k % 6 == 3, form("tel:+39(333)")).when(k % 6 == 4, F.lit("not-a-phone"))
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).withColumn("phone", text.phone_e164(F.col("raw"), F.lit("IT")))


@query(f"WITH {_PHONES} SELECT c_custkey, raw, phone, length(regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g')) >= 9 AS full_phone FROM e164")
def phone_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones in several spellings to E.164 (O9.1, O9.2)."""
    return _phones(spark, sf_dir).withColumn("full_phone", text.full_phone(F.col("raw")))


@query(f"WITH {_PHONES} SELECT c_custkey, substr(phone, 1, 3) || repeat('*', CAST(length(phone) - 5 AS INTEGER)) || right(phone, 2) AS masked, '***' || right(regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g'), 4) AS tail FROM e164")
def phone_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked phones (O9.4, O9.5)."""
    return _phones(spark, sf_dir).select("c_custkey", text.mask_phone(F.col("phone")).alias("masked"), text.mask_tail(F.col("raw")).alias("tail"))


@query()
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without links and phones, and whether their numbers are the same (O9.17, O9.22).

    DuckDB's patterns can't look around, as the phone's do; a test holds it against Python's.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", text.redact(F.col("text")).alias("redacted"))
    return d.select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"), text.numbers(F.col("text")).eqNullSafe(text.numbers(F.col("redacted"))).alias("numbers_kept"))


@query("""SELECT doc_id, CASE WHEN k = 'age' THEN 'eta' ELSE k END AS key FROM (SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS k FROM documents)""")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded key of each whole text (O9.20); ``accent_fold_words`` has those of all words."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_key(F.col("text")).alias("key"))


@query("""SELECT DISTINCT CASE WHEN k = 'age' THEN 'eta' ELSE k END AS key FROM (SELECT regexp_replace(regexp_replace(strip_accents(lower(w)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS k
FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM documents))""")
def accent_fold_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded keys of every word of every text (O9.20)."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)))
    words = dealt(table(spark, sf_dir, "documents").select(words.alias("word")).distinct())  # not dealt out, the distinct below makes Spark drop this one and fold every place of a word
    return words.select(text.fold_key(F.col("word")).alias("key")).distinct()


@query("SELECT event_id, event_type AS code, 'm ' || event_id AS message, '[' || event_type || '] m ' || event_id AS encoded FROM events")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with their code in front, and taken apart again (O9.21)."""
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", text.encode_error(F.col("event_type"), F.concat(F.lit("m "), F.col("event_id").cast("string"))).alias("encoded"))
    code, message = text.decode_error(F.col("encoded"))
    return e.select("event_id", code.alias("code"), message.alias("message"), "encoded")


@query("""SELECT code, count(*) AS n FROM (SELECT CASE WHEN starts_with(message, '[') AND contains(message, '] ') AND regexp_matches(message, '^\\[[a-z_]+\\] ') THEN substr(message, 2, strpos(message, '] ') - 2) END AS code
FROM (SELECT CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN '[' || event_type || '] gone' WHEN 1 THEN '[' || event_type || '_code] [x] y' WHEN 2 THEN event_type || ' without a code' ELSE '[' || upper(event_type) || '] odd' END AS message FROM events WHERE event_type <> 'view')) GROUP BY 1""")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by the code in front of their messages, null where there is none (O4.23, O9.21)."""
    kind, i = F.col("event_type"), F.col("event_id") % 4
    message = F.when(i == 0, F.concat(F.lit("["), kind, F.lit("] gone"))).when(i == 1, F.concat(F.lit("["), kind, F.lit("_code] [x] y"))).when(i == 2, F.concat(kind, F.lit(" without a code")))
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").select(message.otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("] odd"))).alias("message"))
    code, _ = text.decode_error(F.col("message"))
    return e.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


_HEADS = (
    "FFD8FFE0", "89504E470D0A1A0A00", "474946383761", "47494638396100", "1A45DFA3", "524946460000000057454250", "524946460000000057415645", "000000000000000057454250",
    "00000018667479706D703432", "000000146674797071742020", "000000000000000071742020", "0000001866747970", "89504E47", "FFD8", "3C68746D6C3E", "",
)


@query(f"""WITH h AS (SELECT page_id, list_extract({list(_HEADS)}, CAST(page_id % {len(_HEADS)} AS INTEGER) + 1) AS x FROM pages)
SELECT page_id, CASE WHEN starts_with(x, '52494646') AND substr(x, 17, 8) = '57454250' THEN 'image/webp' WHEN length(x) >= 24 AND substr(x, 9, 8) = '66747970' THEN CASE WHEN substr(x, 17, 8) = '71742020' THEN 'video/quicktime' ELSE 'video/mp4' END
  WHEN starts_with(x, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(x, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(x, '474946383761') OR starts_with(x, '474946383961') THEN 'image/gif' WHEN starts_with(x, '1A45DFA3') THEN 'video/webm' ELSE 'application/octet-stream' END AS mime FROM h""")
def mime_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by magic numbers, on heads that have them, lack a part of them or have them at the wrong place (O9.23)."""
    heads = F.array(*[F.unhex(F.lit(x)) for x in _HEADS])
    return table(spark, sf_dir, "pages").select("page_id", text.mime_type(F.get(heads, (F.col("page_id") % len(_HEADS)).cast("int"))).alias("mime"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y%m%d%H') AS hour, strftime(ts, '%Y%m%d%H%M') AS minute, ts + to_minutes(CAST(event_id % 60 AS INTEGER)) AS later, CAST(event_id * 7 % 9000 AS BIGINT) AS seconds,
  CASE WHEN event_id * 7 % 9000 >= 3600 THEN CAST(event_id * 7 % 9000 // 3600 AS VARCHAR) || 'h ' || CAST(event_id * 7 % 9000 % 3600 // 60 AS VARCHAR) || 'm' ELSE CAST(event_id * 7 % 9000 // 60 AS VARCHAR) || 'm ' || CAST(event_id * 7 % 9000 % 60 AS VARCHAR) || 's' END AS duration FROM events""")
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets, intervals and durations (O10.1, O10.4, O10.5, O10.6, O10.7)."""
    seconds = (F.col("event_id") * 7 % 9000).cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyyMMdd").alias("day"), F.date_format("ts", "yyyyMMddHH").alias("hour"), F.date_format("ts", "yyyyMMddHHmm").alias("minute"),
        (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 60).cast("int"))).alias("later"),
        numbers.seconds_between(F.col("ts"), F.timestamp_add("SECOND", seconds, F.col("ts"))).alias("seconds"), numbers.duration_text(seconds).alias("duration"),
    )


@query("""WITH l AS (SELECT event_id, TIMESTAMP '2026-03-28 00:00:00' + to_days(CAST(event_id % 3 AS INTEGER)) + (ts - date_trunc('day', ts)) AS wall FROM events)
SELECT event_id, CASE WHEN wall < TIMESTAMP '2026-03-29 02:00:00' THEN wall - INTERVAL 1 HOUR WHEN wall >= TIMESTAMP '2026-03-29 03:00:00' THEN wall - INTERVAL 2 HOUR END AS utc FROM l""")
def dst_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' times of day as local times of Rome, on days around the night when an hour is skipped (O10.2)."""
    day = F.date_add(F.lit("2026-03-28").cast("date"), (F.col("event_id") % 3).cast("int")).cast("timestamp")
    wall = day + (F.col("ts") - F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", numbers.local_to_utc(wall, "Europe/Rome").cast("timestamp_ntz").alias("utc"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS fingerprint FROM events""")
def json_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON, its hash, validity and a path (O9.12, O9.13, O10.11, O10.16, O10.17)."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), v.isNotNull().alias("valid"), jsonx.json_hash(F.col("props")).alias("fingerprint"))


@query("""SELECT event_id, x, y, w, h, x >= 0 AND y >= 0 AND x + w <= 100 AND y + h <= 100 AS inside FROM (SELECT event_id, event_id % 97 AS x, event_id % 89 AS y, event_id % 31 AS w, event_id % 23 AS h FROM events)""")
def box_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes within a frame (O10.18)."""
    i = F.col("event_id")
    b = table(spark, sf_dir, "events").select("event_id", *[(i % m).alias(c) for c, m in (("x", 97), ("y", 89), ("w", 31), ("h", 23))])
    return b.withColumn("inside", (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= 100) & (F.col("y") + F.col("h") <= 100))


@query("""WITH f AS (SELECT user_id AS record_id, event_type AS field, user_id % 10 AS source_id, json_extract_string(props, '$.k') AS value, event_id FROM events),
u AS (SELECT record_id, field, source_id, value, min(event_id) AS first_id FROM f GROUP BY ALL)
SELECT record_id, field, string_agg(value, ',' ORDER BY first_id) AS grouped, count(*) AS n FROM u GROUP BY 1, 2""")
def custom_field_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each field in order of their first appearance, one for each source and value (O4.14, O4.15)."""
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("field"), (F.col("user_id") % 10).alias("source_id"), F.get_json_object("props", "$.k").alias("value"), "event_id")
    u = f.groupBy("record_id", "field", "source_id", "value").agg(F.min("event_id").alias("first_id"))
    g = u.groupBy("record_id", "field").agg(F.array_sort(F.collect_list(F.struct("first_id", "value"))).alias("v"))  # a record's distinct values
    return g.select("record_id", "field", F.array_join(F.transform("v", lambda x: x["value"]), ",").alias("grouped"), F.size("v").cast("long").alias("n"))


@query("""WITH f AS (SELECT user_id, event_type AS k, props AS v, event_id FROM events) SELECT user_id, k, arg_min(v, event_id) AS first_wins, arg_max(v, event_id) AS last_wins FROM f GROUP BY 1, 2""")
def first_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last value of each key (O10.14)."""
    f = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("k"))
    return f.agg(F.min_by("props", "event_id").alias("first_wins"), F.max_by("props", "event_id").alias("last_wins"))


@query("""WITH r AS (SELECT conv_id, arg_min(text, turn) AS item, md5(coalesce(text, '')) AS f, min(turn) AS t FROM conversations GROUP BY conv_id, text), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, f) AS rn FROM r)
SELECT conv_id, string_agg(f, ',' ORDER BY rn) AS items, count(*) >= 3 AS limit_reached FROM n WHERE rn <= 3 GROUP BY 1""")
def paginated_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all pages, in order, those not seen before, up to three (O10.13)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit(""))).alias("f"))
    out = linkage.merged_pages(c, "conv_id", ["turn", "f"], F.col("f"), F.col("f"), 3)
    return out.select("conv_id", F.array_join("values", ",").alias("items"), "limit_reached")


@query("""WITH r AS (SELECT conv_id, role, min(turn) AS t, arg_min(md5(coalesce(text, '')), turn) AS v FROM conversations GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, role) AS rn FROM r)
SELECT conv_id, string_agg(role || '=' || v, ',' ORDER BY rn) AS pairs, count(*) >= 2 AS limit_reached FROM n WHERE rn <= 2 GROUP BY 1""")
def paginated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value of all pages: the first value of a key, up to two keys (O10.13)."""
    pair = F.concat_ws("=", "role", F.md5(F.coalesce("text", F.lit(""))))
    out = linkage.merged_pages(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], F.col("role"), pair, 2)
    return out.select("conv_id", F.array_join("values", ",").alias("pairs"), "limit_reached")


_VALUES = ('"  "', '"x"', '""', "[]", "[1]", '[""]', "{}", '{"a":1}', "null", "3", "true", "[[]]", "not json", '"\\u00e9"')


@query("""WITH v AS (SELECT event_id, list_extract(%s, CAST(event_id %% %d AS INTEGER) + 1) AS x FROM events), k AS (SELECT event_id, x, CASE WHEN json_valid(x) THEN json_type(x) END AS kind FROM v)
SELECT event_id, coalesce(CASE WHEN kind = 'VARCHAR' THEN trim(json_extract_string(x, '$')) <> '' WHEN kind = 'ARRAY' THEN json_array_length(x) > 0 ELSE kind = 'OBJECT' END, false) AS informative FROM k""" % (list(_VALUES), len(_VALUES)))
def has_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which JSON values count as informative: text, lists, objects, scalars and what isn't JSON (O10.12)."""
    value = F.get(F.array(*map(F.lit, _VALUES)), (F.col("event_id") % len(_VALUES)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", jsonx.has_value(value).alias("informative"))


@query("""WITH f AS (SELECT event_id, event_type, value, '{"type": "' || event_type || '", "note": ' || CASE WHEN event_id % 3 = 0 THEN '" "' ELSE 'null' END || ', "tags": ' || CASE WHEN value > 10 THEN '["a"]' ELSE '[]' END || ', "data": ' || props || '}' AS fields FROM events)
SELECT event_id, 2 + CAST(value > 10 AS INTEGER) AS extra, CAST(value > 20 AS INTEGER) + CAST(event_type <> 'view' AS INTEGER) + 2 + CAST(value > 10 AS INTEGER) AS completeness FROM f""")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled fields of an occurrence and informative ones among its custom fields (O4.13)."""
    note, tags = F.when(F.col("event_id") % 3 == 0, '" "').otherwise("null"), F.when(F.col("value") > 10, '["a"]').otherwise("[]")
    fields = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "note": '), note, F.lit(', "tags": '), tags, F.lit(', "data": '), "props", F.lit("}"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", jsonx.informative_fields(fields).alias("extra"))
    title, description = F.when(F.col("value") > 20, "t").otherwise(" \t"), F.when(F.col("event_type") != "view", F.col("event_type"))
    return e.select("event_id", "extra", (text.filled_fields(title, description, F.lit("")) + F.col("extra")).alias("completeness"))


_ANSWER = """'{"summary": ' || CASE WHEN event_type = 'error' THEN 'null' ELSE '"' || event_type || '"' END || ', "advertisement_information": [{"source_ref": "r", "title": ' || CASE WHEN value > 20 THEN 'null' ELSE '"t"' END || ', "facts": [' || CASE WHEN floor(value * 100) % 10 = 3 THEN '3' ELSE '"f"' END || ']'
  || CASE WHEN floor(value * 10) % 10 = 7 THEN ', "more": 1' ELSE '' END || '}], "forum_information": [' || CASE WHEN user_id % 3 = 0 THEN '{"snippet": "s"}' WHEN user_id % 3 = 1 THEN '' ELSE '{}' END || '], "unverified_claims": [], "sources": ["u"]' || CASE WHEN value < 2 THEN ', "extra": ' || props ELSE '' END || CASE WHEN value > 60 THEN '' ELSE '}' END"""


@query(f"""WITH a AS (SELECT event_id, {_ANSWER} AS x FROM events), j AS (SELECT event_id, CASE WHEN json_valid(x) THEN CAST(x AS JSON) END AS j FROM a),
k AS (SELECT event_id, j, list_sort(json_keys(j)) = ['advertisement_information', 'forum_information', 'sources', 'summary', 'unverified_claims'] AS keys, list_sort(json_keys(j, '$.advertisement_information[0]')) = ['facts', 'source_ref', 'title'] AS ad_keys,
  json_array_length(j, '$.forum_information') = 0 OR json_keys(j, '$.forum_information[0]') = ['snippet'] AS forum FROM j)
SELECT event_id, coalesce(keys AND ad_keys AND forum AND json_type(j, '$.summary') = 'VARCHAR' AND json_type(j, '$.advertisement_information[0].facts[0]') = 'VARCHAR', false) AS valid FROM k""")
def answer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of exactly the form asked for, nested, no field more (O10.17)."""
    return table(spark, sf_dir, "events").select("event_id", jsonx.follows(F.expr(_ANSWER), jsonx.SUMMARY).alias("valid"))


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events), s AS (SELECT *, CASE event_type WHEN 'view' THEN ['{"k":"new"}', '1', '2'] WHEN 'click' THEN ['{"k":' || k || '}', '"new"', '2'] WHEN 'error' THEN ['{"k":' || k || '}', '1', '2'] ELSE NULL END AS p FROM e)
SELECT event_id, CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'signup' THEN '{"custom":{"list":[{"t":1},2],"props":{"k":' || k || '}},"new":"new","title":"' || event_type || '"}' WHEN event_type = 'error' THEN '{"custom":{"list":[{"t":1},2],"props":{"k":' || k || '}},"title":"new"}'
  ELSE '{"custom":{"list":[{"t":' || p[2] || '},2],"props":' || p[1] || '},"title":"' || event_type || '"}' END AS edited, CASE WHEN event_type = 'purchase' THEN NULL ELSE '"new"' END AS got FROM s""")
def set_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value put under each row's own path, through objects and lists, and read back (O10.11); a path that leads nowhere gives null."""
    kind = F.col("event_type")
    doc = F.concat(F.lit('{"title": "'), kind, F.lit('", "custom": {"props": '), "props", F.lit(', "list": [{"t": 1}, 2]}}'))
    path = F.when(kind == "view", "custom.props.k").when(kind == "click", "custom.list.0.t").when(kind == "error", "title").when(kind == "signup", "new").otherwise("custom.list.9.t")
    e = table(spark, sf_dir, "events").select("event_id", path.alias("path"), jsonx.set_path(doc, path, F.lit('"new"')).alias("edited"))
    return e.select("event_id", "edited", jsonx.get_path(F.col("edited"), F.col("path")).alias("got"))


@query()
def summary_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of what a summary of each conversation would be made of (O9.12), texts redacted; a test holds it against Python's JSON."""
    turn = F.struct("turn", "role", text.redact(F.coalesce("text", F.lit(""))).alias("text"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # a conversation's own turns
    roles = F.array_distinct(F.transform("turns", lambda t: t["role"]))
    adverts = F.transform("turns", lambda t: jsonx.advert(F.concat(F.lit("source-"), F.array_position(roles, t["role"]).cast("string")), t["role"], t["text"], t["turn"].cast("string")))
    return c.select("conv_id", jsonx.summary_hash(adverts, "local", "small", "v1", F.size("turns")).alias("input_hash"))


_WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
#: What is searched for: all of the words, or a phrase.
_SEARCHES = (("licensed under", False), ("Released under the MIT License", True), ("der die das", False), ("of the", True), ("version 3", True), ("nothing-like-this xyzzy", False), ("the the", True))


def _search_sql() -> str:
    each = []
    for i, (asked, phrase) in enumerate(_SEARCHES):
        words = asked.lower().replace("-", " ").split()
        if phrase:
            there = " AND ".join(f"w[i + {j}] = '{word}'" for j, word in enumerate(words))
            hits = f"len(list_filter(range(1, len(w) + 1), lambda i: {there}))"
        else:
            hits = f"CASE WHEN list_has_all(w, {words}) THEN len(list_filter(w, lambda x: list_contains({words}, x))) ELSE 0 END"
        each.append(f"SELECT {i} AS search, doc_id, {hits} AS hits FROM d")
    return f"WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) SELECT CAST(search AS INTEGER) AS search, doc_id, CAST(hits AS BIGINT) AS hits FROM ({' UNION ALL '.join(each)}) WHERE hits > 0"


def _index(spark: SparkSession, sf_dir: str) -> str:
    """An index of the documents, a batch for each language."""
    path, docs = scratch(spark, "text-index"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    textindex.add_batch(docs, path, F.coalesce("lang", F.lit("none")))
    return path


@query(_search_sql())
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all of some words, and with phrases, found through the index alone (O9.25)."""
    path = _index(spark, sf_dir)
    found = [textindex.search(spark, path, asked, phrase).select(F.lit(i).alias("search"), "doc_id", "hits") for i, (asked, phrase) in enumerate(_SEARCHES)]
    return reduce(DataFrame.unionByName, found)


@query(f"""WITH b AS (SELECT item_id, {_WORDS.format('text')}[1:4] AS p FROM benchmark), d AS MATERIALIZED (SELECT doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS t FROM documents), m AS (SELECT item_id, doc_id, t, p FROM b JOIN d ON len(p) > 0 AND contains(t, ' ' || array_to_string(p, ' ') || ' '))
SELECT item_id, doc_id, CAST(len(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) AS BIGINT) AS hits FROM (SELECT item_id, doc_id, p, string_split(trim(t), ' ') AS w FROM m)""")
def fulltext_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first four words of each benchmark item stand, all items in one join with the index (O9.25)."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(textindex.words_of(F.col("text")), 1, 4), " ").alias("text"))
    return textindex.search_phrases(asked, _index(spark, sf_dir)).withColumnRenamed("query", "item_id")
