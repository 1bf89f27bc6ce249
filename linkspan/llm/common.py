"""Shared folder handling and small column helpers of the corpus operators."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


#: Where tables go that only a ``settle`` under way needs.
_SCRATCH: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is missing, a local session (tests) gets a temporary folder in its place; on a cluster,
    whose executors don't see such a folder, it is an error.
    """
    if scratch := _SCRATCH.get():
        return f"{scratch}/{name}-{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-linkspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/linkspan/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    It cuts the lineage, so that Python work is not done again for each use and lost executors
    cost no more than a read.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Materialize what ``build`` gives, and remove the tables that it materialized on the way."""
    path, scratch = shared_folder(spark, name), shared_folder(spark, f"{name}-scratch")
    token = _SCRATCH.set(scratch)
    try:
        df = build()
        df.write.option("compression", "zstd").parquet(path)
    finally:
        _SCRATCH.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(scratch)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint when ``rows``, counted beforehand, is within ``limit``; else a shuffled join.

    Callers give tables of numbers and digests alone, so that a limit of rows is one of bytes.
    """
    return F.broadcast(df) if rows <= limit else df


def labelled_sample(labels: DataFrame, column: str, per_class: int, where: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class 0 and 1, chosen by a hash of the id, and the
    number of rows of each class before the choice. Rows with a null id or another label don't count.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if where is not None:
        rows = rows.where(where)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    part = [lowest(rows.where(F.col("label") == c), F.xxhash64("doc_id"), sizes.get(c, 0), per_class) for c in (0, 1)]
    return part[0].unionByName(part[1]), sizes


def lowest(rows: DataFrame, hashed: Column, size: int, n: int) -> DataFrame:
    """About the ``n`` rows of lowest hash out of ``size``, never more than ``n``.

    A bound on the hash comes first, so that the one task which takes the last choice reads some ``2 * n``
    rows from all tasks together, and not ``n`` from each.
    """
    place = F.pmod(hashed, F.lit(1 << 40))
    if size > 2 * n:
        rows = rows.where(place < int((1 << 40) * 2 * n / size))
    return rows.orderBy(place, *rows.columns).limit(n)


def set_aside(docs: DataFrame, *used: str, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with each column but those ``used`` under a name that no operator has (aside_0, aside_1, ...), and the
    callers' names by all names. Columns that a result replaces are left out; names are matched without regard to case.
    """
    out = {c.lower() for c in replaced}
    names = {c if c in used else f"aside_{i}": c for i, c in enumerate(docs.columns) if c.lower() not in out}
    return docs.select(*[F.col(f"`{c}`").alias(own) for own, c in names.items()]), names


def named_back(names: dict[str, str], **instead: Column) -> list[Column]:
    """The callers' columns after ``set_aside``, in their order; ``instead`` has other values for some of them."""
    return [instead.get(own, F.col(own)).alias(c) for own, c in names.items()]


def passing_schema(df: DataFrame, *added: tuple[str, DataType]) -> tuple[DataFrame, StructType]:
    """``df`` without columns of the added names, and the schema of its rows with those added.

    Names are matched without regard to case, as Spark does.
    """
    names = {n.lower() for n, _ in added}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    return df, StructType([*df.schema.fields, *(StructField(n, t) for n, t in added)])
