"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

An item's windows are its runs of ``width`` words (a shorter item is one window). A window is a set
of placed shingles of ``shingle`` words. As all of them must be contained, one shingle is a prefix
long enough: the rarest one by its count over all documents. Documents' shingles meet these prefixes by
a hash, and only numbers take part in that: the place of the prefix inside the window gives where the window
would start, and starts before the first or windows past the last word of the document go. What is left is
joined with the words of its documents alone and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialize, named_back, set_aside, settle

#: Fixed value: what separates words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of numbers (32 bytes each at most) that may be broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of windows, with 100 more for each, that may be broadcast.
BROADCAST_BYTES = 64 << 20


def normal_words(text: Column) -> Column:
    """The words of a text, joined by one space; null has none."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN, " "))


def _words(column: str) -> Column:
    """Words of normalised text; no words: one empty string, which nothing can match."""
    return F.split(F.col(column), " ")


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """item_id, window (its words joined by spaces), n (number of words): distinct rows.

    Items with a null id or without words have no windows.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", normal_words(F.col("text")).alias("words")).where("words <> ''")
    items = items.select("item_id", _words("words").alias("words")).withColumn("n", F.least(F.lit(width), F.size("words")))
    items = items.select("item_id", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    return items.select("item_id", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("window"), "n").distinct()


def _hash(size: int) -> Column:
    """Hash of the ``size`` words that start at ``at``; past the end there is none."""
    later = [F.get(F.col("words"), F.col("at") + j) for j in range(1, size)]
    h = F.xxhash64(F.lit(size), "first", *later)
    return F.when(later[-1].isNotNull(), h) if later else h


def _shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """uid, at, n_words, hash: the shingles of each document's words, as numbers alone."""
    rows = docs.select("uid", "n_words", _words("words").alias("words")).select("uid", "n_words", "words", F.posexplode_outer("words").alias("at", "first"))
    each = F.explode(F.array(*[_hash(s) for s in sizes])).alias("hash") if len(sizes) > 1 else _hash(sizes[0]).alias("hash")
    return rows.select("uid", "at", "n_words", each).where(F.col("hash").isNotNull())


def _window_shingles(windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """wid, n, place, hash of every shingle of every window (wid, window, n)."""
    parts = windows.withColumn("ws", _words("window")).withColumn("size", F.least("n", F.lit(shingle)))
    parts = parts.select("wid", "n", "ws", "size", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), lambda i: F.slice("ws", i, F.col("size")))).alias("place", "words"))
    h = F.coalesce(*[F.when(F.col("size") == s, F.xxhash64(F.lit(s), *[F.get("words", F.lit(j)) for j in range(s)])) for s in sizes])
    return parts.select("wid", "n", "place", h.alias("hash"))


def candidates(docs: DataFrame, windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """uid, wid, start, n: where the prefix of a window stands in a document with room for the whole window.

    ``docs`` has uid, words and n_words, ``windows`` wid, window and n. No words pass a shuffle.
    """
    parts = materialize(_window_shingles(windows, sizes, shingle), "window-shingles")
    keys = materialize(parts.select("hash").distinct(), "window-hashes")
    n_keys = keys.count()
    rows = _shingles(docs, sizes)
    # How common each shingle is over all documents; hashes are added up in each task before they are shuffled.
    if n_keys <= BROADCAST_ROWS:
        seen = rows.join(F.broadcast(keys), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("seen"))
    else:
        seen = rows.groupBy("hash").agg(F.count("*").alias("seen")).join(keys, "hash", "left_semi")
    order = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "place", "hash")
    prefixes = parts.join(seen, "hash", "left").groupBy("wid", "n").agg(F.min(order).alias("p")).where("p.seen > 0")
    prefixes = materialize(prefixes.select("p.hash", "wid", "n", "p.place"), "prefixes")
    found = rows.join(broadcast_if_small(prefixes, prefixes.count(), BROADCAST_ROWS), "hash")
    start = F.col("at") - F.col("place")
    return found.where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("uid", "wid", start.alias("start"), "n")


def window_hits(docs: DataFrame, windows: DataFrame, shingle: int = 3) -> DataFrame:
    """uid, wid, start, n of every occurrence of ``windows`` (wid, window, n) in ``docs`` (uid, words, n_words)."""
    sizes = sorted(r["n"] for r in windows.select(F.least("n", F.lit(shingle)).alias("n")).distinct().collect())  # at most ``shingle`` numbers
    if not sizes:
        return docs.where(F.lit(False)).select("uid", F.lit(0).cast("long").alias("wid"), F.lit(0).alias("start"), F.lit(0).alias("n"))
    maybe = materialize(candidates(docs, windows, sizes, shingle), "window-candidates")
    needed = materialize(maybe.select("uid").distinct(), "candidate-documents")
    of_these = docs.select("uid", "words").join(broadcast_if_small(needed, needed.count(), BROADCAST_ROWS), "uid", "left_semi")
    of_these = materialize(of_these, "candidate-words")
    size = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + 100).alias("bytes")).first()
    texts = windows.select("wid", "window")
    texts = F.broadcast(texts) if size["bytes"] <= BROADCAST_BYTES else texts
    placed = maybe.join(of_these.select("uid", _words("words").alias("ws")), "uid").select("uid", "wid", "start", "n", F.array_join(F.slice("ws", F.col("start") + 1, F.col("n")), " ").alias("there"))
    return placed.join(texts, "wid").where(F.col("there") == F.col("window")).select("uid", "wid", "start", "n")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 3) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the items that such windows come
    from. Null or empty texts have no words and are clean; very long ones are taken whole; repeated rows and
    null ids each keep their row; columns of ``docs`` with one of the added names are replaced, all others stay;
    either table may be empty. Items with a null item_id are left out; an item_id on several rows counts once.
    """
    kept, names = set_aside(docs, "text", replaced=("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    base = kept.withColumns({"uid": F.monotonically_increasing_id(), "words": normal_words(F.col("text"))})
    n_words = F.when(F.col("words") == "", 0).otherwise(F.size(_words("words")))
    base = materialize(base.withColumn("n_words", n_words), "decontaminate")

    def found() -> DataFrame:
        items = materialize(benchmark_windows(benchmark, width), "item-windows")
        windows = materialize(items.select("window", "n").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
        hits = materialize(window_hits(base.select("uid", "words", "n_words"), windows, shingle), "window-hits")
        # Words in the union of the occurrences, by document: each adds what reaches beyond the ones before.
        before = Window.partitionBy("uid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("n")
        new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
        words = hits.select("uid", "start", "n").distinct().select("uid", new.alias("new")).groupBy("uid").agg(F.sum("new").alias("n_hit"))
        owners = materialize(items.join(windows, ["window", "n"]).select("wid", F.col("item_id").cast("string").alias("item")), "window-items")
        owned = hits.select("uid", "wid").distinct().join(owners, "wid").select("uid", "item").distinct()
        owned = owned.groupBy("uid").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
        return words.join(owned, "uid")

    hit = settle(docs.sparkSession, "contaminated", found)
    out = base.join(broadcast_if_small(hit, hit.count(), BROADCAST_ROWS), "uid", "left")
    return out.select(
        *named_back(names),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH item AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE item_id IS NOT NULL),
full_item AS (SELECT item_id, w, least(10, len(w)) AS n FROM item WHERE w <> ['']),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM full_item)),
doc AS (SELECT row_number() OVER () AS u, doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g')), ' ') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc CROSS JOIN sizes WHERE len(w) >= n),
hit AS (SELECT u, i, spot.n, item_id FROM spot JOIN win ON spot.n = win.n AND array_to_string(w[i:i + spot.n - 1], ' ') = win.win),
word AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(i, i + n)) AS p FROM hit) GROUP BY u),
ids AS (SELECT u, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT u, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY u)
SELECT doc_id, CASE WHEN w = [''] THEN 0 ELSE len(w) END AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (u) LEFT JOIN ids USING (u)
"""
