"""Token ids in a compressed, indexed file format.

A file is a Parquet part file in which each row is a chunk of at most ``CHUNK`` ids: whole documents in ascending doc_id
order, or a part of one that is longer. A chunk's ids are cut into blocks of ``BLOCK`` ids. Each block is transposed into planes of
its own, by bytes (plane b has byte b of every id) or by bits, and each plane of each block is compressed with zstandard. The
row is the chunk's index: shard, chunk number, first id within the shard, the documents' ids, where in its document each piece
starts, the pieces' lengths and the documents' lengths, and where each compressed plane ends. So a chunk can be read alone, and of a
chunk any range of ids by the blocks that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder
from .tokens import encoder, public_path

BLOCK = 4096
CHUNK = 1 << 18
SCHEMA = "shard int, chunk int, first long, n_ids long, bits boolean, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>, doc_totals array<long>, ends array<int>, planes binary"
_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.bool_()), ("doc_ids", _LONGS), ("doc_starts", _LONGS), ("doc_lengths", _LONGS),
        ("doc_totals", _LONGS), ("ends", pa.list_(pa.int32())), ("planes", pa.binary()),
    ]
)
PIECES = "doc_id long, doc_start long, piece_start long, n_tokens long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("doc_start", pa.int64()), ("piece_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def block_planes(ids: np.ndarray, bits: bool, level: int = 3) -> list[bytes]:
    """Compressed planes of one block of unsigned 32-bit ids: 4 of bytes or 32 of bits."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4)
    planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little") if bits else raw.T
    pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_block(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ``n`` ids of a block."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    raw = np.stack([np.frombuffer(unpack.decompress(p), "u1") for p in planes])
    if bits:
        each = np.unpackbits(raw, axis=1, count=n, bitorder="little").T
        return np.ascontiguousarray(np.packbits(each, axis=1, bitorder="little")).view("<u4").reshape(-1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def to_blocks(ids: np.ndarray, bits: bool) -> tuple[bytes, list[int]]:
    """All blocks' planes one after the other, and where each ends."""
    planes = [p for at in range(0, len(ids), BLOCK) for p in block_planes(ids[at : at + BLOCK], bits)]
    return b"".join(planes), np.cumsum([len(p) for p in planes], dtype="i8").tolist()


def from_blocks(planes: bytes, ends: list[int], n: int, bits: bool, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a chunk of ``n``; only their blocks are decompressed."""
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, "<u4")
    each, first, last = 32 if bits else 4, start // BLOCK, -(-stop // BLOCK)
    parts = []
    for b in range(first, last):
        cuts = [ends[b * each - 1] if b else 0, *ends[b * each : (b + 1) * each]]
        parts.append(from_block([planes[x:y] for x, y in zip(cuts, cuts[1:])], min(BLOCK, n - b * BLOCK), bits))
    return np.concatenate(parts)[start - first * BLOCK : stop - first * BLOCK]


def _encode(path: str, end_id: int, bits: bool, size: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, end = encoder(path), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        held: list[tuple] = []  # doc_id, start in the document, bytes, the document's length
        first = chunk = n = 0

        def close() -> pa.RecordBatch:
            nonlocal first, chunk, n, held
            docs, starts, parts, totals = zip(*held)
            planes, ends = to_blocks(np.frombuffer(b"".join(parts), "<u4"), bits)
            row = [shard, chunk, first, n, bits, docs, starts, [len(p) // 4 for p in parts], totals, ends, planes]
            first, chunk, n, held = first + n, chunk + 1, 0, []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW.types)], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(text.as_py()) + end
                total = len(ids) // 4
                if n and n + total > size:
                    yield close()
                for at in range(0, total, size):
                    part = ids[4 * at : 4 * (at + size)]
                    held.append((doc_id, at, part, total))
                    n += len(part) // 4
                    if n >= size:
                        yield close()
        if held:
            yield close()

    return encode


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each chunk, or of its ids ``start`` to ``stop`` where these are given."""
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            low, high = r.get("start", 0), r.get("stop", r["n_ids"])
            raw = from_blocks(r["planes"], r["ends"], r["n_ids"], r["bits"], low, high).tobytes()
            n = np.array(r["doc_lengths"], "i8")
            ends = np.cumsum(n)
            begins = ends - n
            hit = np.flatnonzero((np.minimum(ends, high) > np.maximum(begins, low)))
            a, z = np.maximum(begins[hit], low), np.minimum(ends[hit], high)
            ids = [raw[4 * (x - low) : 4 * (y - low)] for x, y in zip(a.tolist(), z.tolist())]
            starts = np.array(r["doc_starts"], "i8")
            columns = [np.array(r["doc_ids"], object)[hit].tolist(), (r["base"] + begins - starts)[hit], (starts[hit] + a - begins[hit]), np.array(r["doc_totals"], "i8")[hit], ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECES.types)], schema=_PIECES)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, bits: bool = False) -> None:
    """Encode whole texts (null: empty), append ``end_id``, and write them to ``path`` by ascending doc_id.

    Null ids come first; repeated rows and rows of one id are all written, in the order of the rows; an empty
    table writes an empty store; other columns are ignored. The range sort deals documents evenly whatever a
    source's share, also where a third of the rows have one id (or none), as the row's place is the second key. A document of
    more than ``CHUNK`` ids, and no other, is split between chunks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = F.col("doc_id").asc_nulls_first(), F.col("row").asc()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    chunks = dealt.mapInArrow(_encode(tokenizer or public_path("word_bpe_49k.json"), end_id, bits, CHUNK), SCHEMA)
    chunks.write.option("compression", "none").parquet(path)


def _placed(spark, path: str) -> DataFrame:
    """Chunks with ``base``, the place of their first id in the store: the shards' sums are a row for each writing task and are
    broadcast, so no id is shuffled."""
    chunks = spark.read.schema(SCHEMA).parquet(path)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return chunks.join(F.broadcast(base), "shard").withColumn("base", F.col("before") + F.col("first"))


_READ = ("base", "n_ids", "bits", "doc_ids", "doc_starts", "doc_lengths", "doc_totals", "ends", "planes")


def read_pieces(spark, path: str) -> DataFrame:
    """doc_id, doc_start (ids of all documents before it), piece_start (ids of it before the piece), n_tokens (of the whole document) and ids:
    a piece for each document and chunk, at most ``CHUNK`` ids each, so that a document of any length is read with bounded memory."""
    return _placed(spark, path).select(*_READ).mapInArrow(_decode, PIECES)


def read_range(spark, path: str, first: int, stop: int) -> DataFrame:
    """The pieces of ids ``first`` to ``stop`` of the whole store. Chunks beside the range aren't read on from their index, blocks beside
    it not decompressed."""
    low, high = F.greatest(F.lit(first) - F.col("base"), F.lit(0)), F.least(F.lit(stop) - F.col("base"), F.col("n_ids"))
    chunks = _placed(spark, path).select(*_READ, low.cast("long").alias("start"), high.cast("long").alias("stop")).where("start < stop")
    return chunks.mapInArrow(_decode, PIECES)


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it in the store), n_tokens, ids (little-endian bytes), a row for each document.

    Whole documents come straight from their chunks. The pieces of a longer one are joined, which takes the memory of that document's
    own ids; ``read_pieces`` doesn't.
    """
    chunks = _placed(spark, path)
    split = F.exists(F.zip_with("doc_lengths", "doc_totals", lambda n, t: n < t), lambda x: x)  # part of a long document, and perhaps what follows its end
    whole = chunks.where(~split).select(*_READ).mapInArrow(_decode, PIECES)
    parts = chunks.where(split).select(*_READ).mapInArrow(_decode, PIECES)
    piece = F.struct("piece_start", "ids")
    joined = parts.groupBy("doc_start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("p"))  # a document's own
    ids: Column = F.aggregate("p", F.lit(b""), lambda all_of, x: F.concat(all_of, x["ids"]))
    joined = joined.select("doc_id", F.col("doc_start").alias("start"), "n_tokens", ids.alias("ids"))
    return whole.select("doc_id", F.col("doc_start").alias("start"), "n_tokens", "ids").unionByName(joined)


def store_round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write a store and read it back."""
    path = path or shared_folder(docs.sparkSession, "id-store")
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path)
