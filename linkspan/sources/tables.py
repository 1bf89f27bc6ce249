"""Tables, documents, line feeds and exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT, VERSION = "sources", 1
_ENTRY = "struct<name:string,slug:string,baseUrl:string,priority:string,countryCode:string,poolName:string>"
DOCUMENT = f"format string, version int, exportedAt string, sources array<{_ENTRY}>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan (O1.1)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt out to all tasks: a small file is one task otherwise, however much is made of each of its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """A point lookup; Parquet statistics skip the rest (O1.1)."""
    return rows.where(F.col(key) == F.lit(value))


def keyset_page(rows: DataFrame, key: str, after, size: int = 500) -> DataFrame:
    """The next ``size`` rows past ``after`` by key (O1.15)."""
    return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def read_source_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of JSON source documents; broken documents are one row with ``problem`` (O1.9)."""
    raw = spark.read.text(path, wholetext=True)
    doc = raw.select(F.from_json("value", DOCUMENT).alias("d"))
    problem = F.when(F.col("d.format").isNull(), "not a document").when(F.col("d.format") != FORMAT, "unknown format").when(F.col("d.version") != VERSION, "unknown version")
    return doc.select(problem.alias("problem"), F.explode_outer("d.sources").alias("s")).select("problem", "s.*")


def classify_entries(entries: DataFrame, existing: DataFrame, pools: DataFrame) -> DataFrame:
    """``entries`` (name, slug, poolName) with status new, conflict or invalid, and pool none, resolved or missing (O1.9)."""
    copies = F.count("*").over(Window.partitionBy("slug"))
    known = existing.select(F.col("slug").alias("known_slug")).distinct()
    pool = pools.select(F.col("name").alias("known_pool")).distinct()
    out = entries.withColumn("copies", copies).join(known, F.col("slug") == F.col("known_slug"), "left").join(pool, F.col("poolName") == F.col("known_pool"), "left")
    bad = F.coalesce(F.trim("slug") == "", F.lit(True)) | F.coalesce(F.trim("name") == "", F.lit(True)) | (F.col("copies") > 1)
    status = F.when(bad, "invalid").when(F.col("known_slug").isNotNull(), "conflict").otherwise("new")
    found = F.when(F.col("poolName").isNull(), "none").when(F.col("known_pool").isNotNull(), "resolved").otherwise("missing")
    return out.select(*entries.columns, status.alias("status"), found.alias("pool_status"))


def merge_entries(entries: DataFrame, existing: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A full outer merge by ``key``: incoming values win, new rows arrive disabled (O1.10)."""
    old, new = existing.alias("old"), entries.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    outcome = F.when(F.col(f"old.{key}").isNull(), "created").when(F.col(f"new.{key}").isNull(), "kept").otherwise("overwritten")
    merged = [F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in (key, *columns)]
    return joined.select(*merged, F.coalesce("old.enabled", F.lit(False)).alias("enabled"), outcome.alias("outcome"))


def parse_feed(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """host, port, user, secret of ``host:port:user:secret`` lines; the last of equal (host, port) wins (O1.8)."""
    part = F.split(F.trim(line), ":")
    rows = lines.where((F.trim(line) != "") & ~F.trim(line).startswith("#")).select(order, part.alias("p")).where(F.size("p") == 4)
    port = F.try_to_number(F.col("p")[1], F.lit("99999")).cast("int")
    rows = rows.select(order, F.col("p")[0].alias("host"), port.alias("port"), F.col("p")[2].alias("user"), F.col("p")[3].alias("secret"))
    rows = rows.where("host <> '' and port between 1 and 65535 and user <> '' and secret <> ''")
    last = F.max_by(F.struct("user", "secret"), F.col(order)).alias("last")
    return rows.groupBy("host", "port").agg(last).select("host", "port", "last.*")


def export_json(rows: DataFrame, path: str) -> None:
    """JSON lines, text as it is (O1.13)."""
    rows.write.mode("error").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


_CSV = {"header": True, "encoding": "UTF-8", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled; nested columns as canonical JSON (O1.12)."""
    flat = [F.to_json(F.parse_json(F.to_json(c))).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in rows.dtypes]
    rows.select(*flat).write.mode("error").options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``export_csv`` wrote; a text may have line ends."""
    return spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is missing, a local session (tests) gets a temporary folder in its place, for all that it writes; on
    a cluster, whose executors don't see such a folder, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-linkspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/linkspan/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to the shared folder and read back: loops and several uses don't compute it again, and a lost
    executor costs a read."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of keys and numbers with a broadcast hint if a count allows it; else it is joined as Spark chooses."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def manifest(rows: DataFrame, by: str, line: Column) -> DataFrame:
    """For each file: rows, bytes, and the sum of its rows' 32-bit SHA-256 heads (O1.14).

    A sum needs no order, so a file of any size is added up in parts.
    """
    head = F.conv(F.substring(F.sha2(line, 256), 1, 8), 16, 10).cast("long")
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(F.octet_length(line)).cast("long").alias("bytes"), F.sum(head).alias("checksum"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and time of stored objects, without reading them (O1.16)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def long_metrics(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row for each metric of a key (O1.19)."""
    return rows.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "value")
