"""An inverted index over texts: words, the documents that have them and where, as a Parquet table.

A row is one word's postings in one block of documents of one batch: the documents' ids in order and, for each, the word's
places in order. The files are written with Parquet's delta encodings, which keep of ids and places the gaps between them, in as
few bits as these need, and of words what differs from the word before. Rows lie in folders by a hash of the word, in the order
of words, so that a search reads the folders of its words and of these the row groups that hold them. No posting list is
ever in one row: a word of all documents has a row for each ``BLOCK`` of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import broadcast_if_few, stored

#: Ids of a block, and folders.
BLOCK, BUCKETS = 4096, 64
#: Delta encodings; a batch replaces itself alone.
_PACKED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "partitionOverwriteMode": "dynamic"}
#: What is no part of a word.
BETWEEN = r"[^\p{L}\p{N}]+"
SCHEMA = "word string, block long, ids array<long>, places array<array<int>>, batch string, bucket int"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text in their order; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def add_batch(rows: DataFrame, path: str, batch: str | Column, id_column: str = "doc_id", text: str = "text") -> None:
    """Index ``rows`` as one batch, or as the batches that a column names; batches of the same names are replaced, others stay.

    Rows with a null id can't be found and are left out; of rows with one id and equal texts one counts, of different texts all
    places do. Places of a word within a text are collected with that text alone, documents of a word within a block of ids.
    """
    docs = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.lit(batch) if isinstance(batch, str) else batch).alias("batch"))
    each = docs.select("batch", "id", F.explode(_places(words_of(F.col("text")))).alias("w")).select("batch", "id", "w.word", "w.places")
    each = each.withColumns({"block": F.floor(F.col("id") / BLOCK), "bucket": bucket_of(F.col("word"))}).withColumn("part", F.pmod("block", F.lit(8)))
    spread, by = ["bucket", "part"], ["bucket", "part", "batch", "word", "block"]
    each = each.repartition(*spread)  # the one shuffle: groups by more columns than these are already together
    lists = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", "places"))).alias("docs"))  # a block at most
    lists = lists.withColumn("docs", _runs(F.col("docs"), "id", "places"))
    out = lists.select("batch", "bucket", "word", "block", F.transform("docs", lambda d: d["id"]).alias("ids"), F.transform("docs", lambda d: F.when(F.size(d["places"]) > 1, F.array_sort(F.array_distinct(F.flatten(d["places"])))).otherwise(d["places"][0])).alias("places"))
    out = out.sortWithinPartitions("batch", "bucket", "word", "block")
    out.write.mode("overwrite").options(**_PACKED).partitionBy("batch", "bucket").parquet(path)


def _places(words: Column) -> Column:
    """Each word of a list and its places, from the list sorted by word and place: no row leaves its text for that."""
    return _runs(F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("places")))), "word", "places")


def _runs(ordered: Column, key: str, value: str) -> Column:
    """Structs of a list in the order of ``key``, put together: each key once, with the list of its values."""

    def runs(x: Column, starts: Column) -> Column:
        return F.transform(starts, lambda a, k: F.struct(F.get(x, a)[key].alias(key), F.transform(F.slice(x, a + 1, F.coalesce(F.get(starts, k + 1), F.size(x)) - a), lambda e: e[value]).alias(value)))

    def cut(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda e, i: F.when((i == 0) | (F.get(x, i - 1)[key] != e[key]), i)), lambda i: i.isNotNull())
        return F.transform(F.array(starts), lambda s: runs(x, s))[0]

    return F.transform(F.array(ordered), cut)[0]  # lists of one bind what is inside, so that it is made once


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """word, id and places of the words asked for; the scan is pruned to their folders and filtered by them."""
    index = spark.read.schema(SCHEMA).parquet(path)
    found = {r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w"))).collect()}
    return _unpacked(index.where(F.col("bucket").isin(*found) & F.col("word").isin(*words)))


def _unpacked(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in ("ids", "places", "batch", "bucket", "block")]
    return rows.select(*others, F.explode(F.arrays_zip("ids", "places")).alias("d")).select(*others, F.col("d.ids").alias("id"), "d.places")


def search(spark: SparkSession, path: str, text: str, phrase: bool = False) -> DataFrame:
    """doc_id and hits of the documents that have all words of ``text``, or these words one after the other (``phrase``).

    hits are the places of the words, or of the phrase. A text without words finds nothing. Only postings of these words are read.
    """
    words = list(dict.fromkeys(_split(spark, text)))
    order = _split(spark, text)
    if not words:
        return spark.createDataFrame([], "doc_id long, hits long")
    found = postings(spark, path, words)
    if not phrase:
        all_of = found.groupBy("id").agg(F.count_distinct("word").alias("n"), F.sum(F.size("places")).alias("hits")).where(F.col("n") == len(words))
        return all_of.select(F.col("id").alias("doc_id"), F.col("hits").cast("long").alias("hits"))
    asked = F.create_map(*[F.lit(x) for w in words for x in (w, [i for i, v in enumerate(order) if v == w])])
    return _phrases(found.withColumns({"query": F.lit(0), "length": F.lit(len(order)), "at": asked[F.col("word")]})).select("doc_id", "hits")


def _split(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(words_of(F.lit(text))).first()[0]


def _phrases(found: DataFrame) -> DataFrame:
    """query, doc_id and hits from query, length, at (places of the word in the phrase), id and places: a document's places of each word
    of a phrase, moved to where the phrase would start, have the starts in common."""
    lists = found.groupBy("query", "length", "id").agg(F.collect_list(F.struct("at", "places")).alias("of_words"))  # a document's own places
    starts = lambda j: F.transform(F.flatten(F.transform(F.filter("of_words", lambda w: F.array_contains(w["at"], j)), lambda w: w["places"])), lambda p: p - j)
    common = F.aggregate(F.sequence(F.lit(1), F.col("length") - 1), F.array_distinct(starts(F.lit(0))), lambda have, j: F.array_intersect(have, starts(j)))
    hits = F.size(F.when(F.col("length") > 1, common).otherwise(F.array_distinct(starts(F.lit(0)))))
    return lists.select("query", F.col("id").alias("doc_id"), hits.cast("long").alias("hits")).where("hits > 0")


def search_phrases(queries: DataFrame, path: str) -> DataFrame:
    """query, doc_id and hits of many phrases at once (``queries``: query, text); queries without words find nothing.

    A phrase's rarest word names the documents that may have it, and the other words' places are fetched for these alone. So
    a frequent word costs its postings once, not once for each phrase that it is in.
    """
    spark = queries.sparkSession
    asked = queries.select("query", words_of(F.col("text")).alias("w")).where(F.size("w") > 0).select("query", F.size("w").alias("length"), F.posexplode("w").alias("j", "word"))
    asked = stored(asked.groupBy("query", "length", "word").agg(F.collect_list("j").alias("at")).withColumn("bucket", bucket_of(F.col("word"))), "asked")  # a query's own words
    words = stored(asked.select("bucket", "word").distinct(), "asked-words")
    index = spark.read.schema(SCHEMA).parquet(path)
    met = index.join(broadcast_if_few(words), ["bucket", "word"])
    often = stored(met.groupBy("word").agg(F.sum(F.size("ids")).alias("n")), "word-counts")
    known = asked.join(broadcast_if_few(often), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.groupBy("query").agg(F.min(F.struct("n", "word")).alias("rarest")).where("rarest.n > 0").select("query", "rarest.word", bucket_of(F.col("rarest.word")).alias("bucket"))
    rarest = stored(rarest, "rarest-words")
    ids = index.join(broadcast_if_few(rarest), ["bucket", "word"]).select("query", F.explode("ids").alias("id")).distinct()
    wanted = ids.join(broadcast_if_few(asked), "query").select("query", "length", "at", "word", "id")
    # Neither side is broadcast by Spark's own estimate, which doesn't know how many rows a list becomes.
    return _phrases(wanted.join(_unpacked(met).hint("merge"), ["word", "id"]))
