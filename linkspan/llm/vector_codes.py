"""Vector codes by product quantisation; codebooks by Lloyd's rounds that are maintained by changes.

A vector is cut into equal parts, each with a codebook of its own. A round assigns every part to its nearest entry and
replaces entries by the means of their parts. The rows keep their assignments from round to round (written beside the
vectors), and the driver keeps a running integer sum and a count of each entry: a part whose assignment did not change
adds nothing, one that moved is added to its new entry and taken from the old one. Each task adds its plus and minus
up, so a round shuffles at most a row for each entry and task, whatever the number of rows.

Everything is whole numbers, so sums don't depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import broadcast_if_small, materialize, named_back, set_aside, settle, shared_folder

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole numbers beyond these bounds are held at them, so that distances of up to 512 components a part fit 64 bits.
MOST = 1 << 26
#: Rows compared with a codebook at once.
BLOCK = 4096
#: Labels whose sums may be broadcast (a label and a number each).
BROADCAST_LABELS = 100_000


@dataclass
class Codebooks:
    """entries: parts x entries x components of a part; sums and counts of the parts assigned to each."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @property
    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, part: int, entry: int, count: int, total: list[int]) -> None:
        self.counts[part, entry] += count
        self.sums[part, entry] += np.array(total, "i8")

    def replace(self) -> None:
        """Entries become the means of their parts, rounded down; unused ones stay."""
        used = self.counts > 0
        self.entries[used] = self.sums[used] // self.counts[used][:, None]


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Components as whole numbers, by floor; null if the vector or a component is null or not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int")))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first of its nearest entries, and the squared distance."""
    if not x.shape[1] or not len(entries):
        return np.zeros(len(x), "i8"), np.zeros(len(x), "i8")
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = "f8" if 4 * most * most * x.shape[1] < 1 << 53 else "i8"  # float products are exact below 2^53, and faster
    e, best, far = entries.astype(kind), np.empty(len(x), "i8"), np.empty(len(x), "i8")
    own = (e * e).sum(1)
    for at in range(0, len(x), BLOCK):
        b = x[at : at + BLOCK].astype(kind)
        d = own[None, :] - 2 * (b @ e.T)
        k = d.argmin(1)
        best[at : at + BLOCK] = k
        far[at : at + BLOCK] = d[np.arange(len(b)), k] + (b * b).sum(1)
    return best, far


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """rows x parts x components of a column of little-endian 32-bit numbers."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i4").astype("i8").reshape(len(raw), parts, -1) if raw else np.zeros((0, parts, 0), "i8")


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    """rows x parts; -1: not assigned so far."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, parts)


def _pack(fill: int):
    """Numbers of a row, filled up with zeros to the length of all, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(np.r_[np.array(v, "<i4"), np.zeros(fill - len(v), "<i4")]).tobytes() for v in b.column("whole").to_pylist()]
            yield b.drop_columns(["whole"]).append_column("vector", pa.array(rows, pa.binary()))

    return pack


def _assign(entries: np.ndarray):
    parts = len(entries)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _parts(b.column("vector"), parts)
            new = np.stack([nearest(x[:, p], entries[p])[0] for p in range(parts)], 1).astype("<i2")
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("vector"), b.column("code"), pa.array([r.tobytes() for r in new], pa.binary())], ["uid", "vector", "before", "code"])

    return assign


def _changes(parts: int, entries: int):
    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part, entry, count, total: what a task's rows add to entries and take from them, each entry once."""
        counts, sums = np.zeros((parts, entries), "i8"), None
        touched = np.zeros((parts, entries), bool)
        for b in batches:
            x, old, new = _parts(b.column("vector"), parts), _codes(b.column("before"), parts), _codes(b.column("code"), parts)
            sums = np.zeros((parts, entries, x.shape[2]), "i8") if sums is None else sums
            for p in range(parts):
                for codes, sign in ((new, 1), (old, -1)):
                    rows = np.flatnonzero((old[:, p] != new[:, p]) & (codes[:, p] >= 0))
                    at = codes[rows, p]
                    np.add.at(sums[p], at, sign * x[rows, p])
                    np.add.at(counts[p], at, sign)
                    touched[p, at] = True
        part, entry = np.nonzero(touched)
        totals = [sums[p, e].tolist() for p, e in zip(part, entry)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[touched], pa.int64()), pa.array(totals, pa.list_(pa.int64()))], ["part", "entry", "count", "total"])

    return changes


def _add_up(moved: DataFrame, width: int) -> DataFrame:
    """Changes of each entry over all tasks; sums of no components are empty."""
    sums = [F.sum(F.get("total", F.lit(i))) for i in range(width)]
    return moved.groupBy("part", "entry").agg(F.sum("count").alias("count"), (F.array(*sums) if sums else F.array().cast("array<bigint>")).alias("total"))


def _final(entries: np.ndarray):
    parts = len(entries)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _parts(b.column("vector"), parts)
            near = [nearest(x[:, p], entries[p]) for p in range(parts)]
            codes = np.stack([k for k, _ in near], 1).astype("u1")
            code = [r.tobytes().hex() for r in codes]
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns) if n not in ("vector", "code")), pa.array(code, pa.string()), pa.array(sum(d for _, d in near), pa.int64())], [*(n for n in b.schema.names if n not in ("vector", "code")), "code", "error"])

    return final


def _remove(df: DataFrame, path: str) -> None:
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fit_codebooks(vectors: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over ``vectors`` (uid, vector), from the entries ``first``.

    Each round writes the rows with their new assignments and removes the table of the round before.
    """
    spark, (parts, entries, width) = vectors.sparkSession, first.shape
    books = Codebooks(first.copy(), np.zeros(first.shape, "i8"), np.zeros(first.shape[:2], "i8"))
    none = np.full(parts, -1, "<i2").tobytes()
    rows, last = vectors.select("uid", "vector", F.lit(none).alias("code")), None
    for _ in range(rounds):
        path = shared_folder(spark, "assigned")
        rows.mapInArrow(_assign(books.entries.copy()), "uid long, vector binary, before binary, code binary").write.option("compression", "zstd").parquet(path)
        if last:
            _remove(rows, last)
        written = spark.read.schema("uid long, vector binary, before binary, code binary").parquet(path)
        moved = written.where("before <> code").select("vector", "before", "code").mapInArrow(_changes(parts, entries), "part int, entry int, count long, total array<long>")
        for r in _add_up(moved, width).collect():  # a row for each entry at most
            books.moved(r["part"], r["entry"], r["count"], r["total"])
        books.replace()
        rows, last = written.select("uid", "vector", "code"), path
    if last:
        _remove(rows, last)
    return books


def compress_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """``vectors`` with code (hex, two digits a part) and error (squared distances) in place of the vector, and the codebooks.

    Rows whose vector is null or holds null or non-finite components go. Shorter vectors are filled up with zeros to the
    longest one's length, and all to a multiple of ``parts``. The entries start as the parts of the rows with the smallest
    ids, rows of one id in the order of their numbers, null ids last; fewer rows than ``entries`` give as many entries.
    Equal distances go to the lower entry. Repeated rows each keep their row; columns named code or error are replaced, all
    others stay; an empty table gives no rows and codebooks without entries.
    """
    spark = vectors.sparkSession
    kept, names = set_aside(vectors, id_column, vector, replaced=("code", "error"))
    names.pop(vector)
    numbers = kept.withColumn("whole", whole_numbers(F.col(f"`{vector}`"), scale)).drop(vector).where("whole is not null").withColumn("uid", F.monotonically_increasing_id())
    base = materialize(numbers, "whole-vectors")
    longest = base.agg(F.max(F.size("whole"))).first()[0] or 0
    fill = -(-longest // parts) * parts
    packed = StructType([*(f for f in base.schema.fields if f.name != "whole"), StructField("vector", BinaryType())])
    rows = base.mapInArrow(_pack(fill), packed)
    lowest = base.orderBy(F.col(f"`{id_column}`").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    first = np.zeros((len(lowest), fill), "i8")
    for i, r in enumerate(lowest):
        first[i, : len(r["whole"])] = r["whole"]
    first = first.reshape(len(lowest), parts, fill // parts).transpose(1, 0, 2)
    books = fit_codebooks(rows.select("uid", "vector"), first, rounds) if len(lowest) else Codebooks(first, np.zeros(first.shape, "i8"), np.zeros(first.shape[:2], "i8"))
    schema = StructType([*(f for f in base.schema.fields if f.name != "whole"), StructField("code", StringType()), StructField("error", LongType())])
    return rows.mapInArrow(_final(books.entries), schema).select(*named_back(names), "code", "error"), books


def errors_by_label(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with label_error, the sum of error over rows of equal labels; nulls are one label."""
    coded = materialize(coded, "coded")
    sums = coded.groupBy(F.col(label).alias("of_label")).agg(F.sum("error").alias("label_error"))
    sums = settle(coded.sparkSession, "label-errors", lambda: sums)
    return coded.join(broadcast_if_small(sums, sums.count(), BROADCAST_LABELS), F.col(label).eqNullSafe(F.col("of_label")), "left").drop("of_label")


def _oracle() -> str:
    """The rounds one after the other; a part is a list of numbers, a codebook a row for each entry."""
    near = lambda book, name: f"""{name} AS (SELECT vec_id, label, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT part.*, b.e, list_sum(list_transform(range(1, len(part.v) + 1), lambda i: (part.v[i] - b.c[i]) * (part.v[i] - b.c[i]))) AS d FROM part JOIN {book} b USING (p)) GROUP BY ALL)"""
    mean = """SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM {0}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    book = lambda n: f"b{n + 1} AS (WITH m AS ({mean.format(f'a{n}')}) SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m ON m.p = b.p AND m.e = b.e)"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(x * {SCALE}::DOUBLE) AS BIGINT) for x in embedding] AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS MATERIALIZED (SELECT vec_id, label, p, w[p * (len(w) // {PARTS}) + 1:(p + 1) * (len(w) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for n in range(ROUNDS):
        steps += [near(f"b{n}", f"a{n}").replace(" AS (", " AS MATERIALIZED (", 1), book(n).replace(" AS (", " AS MATERIALIZED (", 1)]
    steps += [near(f"b{ROUNDS}", "z").replace(" AS (", " AS MATERIALIZED (", 1), "row AS (SELECT vec_id, label, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY 1, 2)"]
    steps += [f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})"]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM digest) AS codebooks_sha256 FROM row"


ORACLE = _oracle()
