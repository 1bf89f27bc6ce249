"""Harmonic packing of token sequences.

Lengths fall into classes by the reciprocal of the capacity: a piece of class ``k`` takes at most
``capacity // k`` ids, so any ``k`` of them fit a sequence. Each task fills the sequences of a class
with ``k`` pieces as they come, without looking at other tasks or classes. What is left over (fewer
than ``k`` pieces of a class) meets in groups of ``GROUP`` tasks, which fill classes again and put
the very last pieces together by decreasing length; that second round is bounded by the number of
tasks, not by the documents.

A document may be cut anywhere, so its tail is cut to fill slots nearly exactly: a piece stays whole
if it wastes at most ``SLACK`` of its slot, else the largest slot below it is split off.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder, public_path

#: Pieces to a sequence, by class.
CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256)
SLACK = 0.03
GROUP = 64
SCHEMA = "doc_id long, start long, length long, doc_tokens long, class int, sequence_id long, offset long, ids binary, worker int"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("worker", pa.int32())]
)


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(class, length) of the pieces of ``n`` ids, in order."""
    slots = [(k, capacity // k) for k in CLASSES if capacity // k]
    while n > 0:
        k, slot = next((x for x in reversed(slots) if x[1] >= n), slots[0])
        below = next((x for x in slots if x[1] < n), None)
        if n <= slot and (n >= slot * (1 - SLACK) or below is None or k == slots[-1][0]):
            yield k, n
            return
        k, slot = (k, slot) if n >= slot else below
        yield k, slot
        n -= slot


class _Bins:
    """Open sequences by class; ``put`` gives the sequences that are full."""

    def __init__(self, first_id: int):
        self.open: dict[int, list[list]] = defaultdict(list)
        self.next_id = first_id

    def close(self, pieces: list[list]) -> list[list]:
        at = 0
        for p in pieces:
            p[5], p[6] = self.next_id, at
            at += p[2]
        self.next_id += 1
        return pieces

    def put(self, piece: list) -> list[list]:
        pieces = self.open[piece[4]]
        pieces.append(piece)
        return self.close(self.open.pop(piece[4])) if len(pieces) == piece[4] else []

    def rest(self) -> list[list]:
        return [p for pieces in self.open.values() for p in pieces]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


def _fill(path: str, end_id: int, capacity: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, worker, end = encoder(path), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        bins = _Bins(worker << 32)
        out, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(text.as_py()) + end
                n, start = len(ids) // 4, 0
                for k, length in cuts(n, capacity):
                    piece = [doc_id, start, length, n, k, None, None, ids[4 * start : 4 * (start + length)], worker]
                    out += bins.put(piece)
                    start += length
                held += len(ids)
                if held > 8_000_000:
                    yield _batch(out)
                    out, held = [], 0
        yield _batch(out + bins.rest())

    return fill


def _merge(capacity: int):
    def merge(key, batches):
        bins, full = _Bins((1 << 62) + (key[0].as_py() << 32)), []
        rows = [list(r.values()) for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r[4], r[8], -1 if r[0] is None else r[0], r[1]))
        for r in rows:
            full += bins.put(r)
        rooms: list[list] = []  # [room left, pieces]
        for p in sorted(bins.rest(), key=lambda p: -p[2]):
            room = next((x for x in rooms if x[0] >= p[2]), None)
            if room is None:
                rooms.append(room := [capacity, []])
            room[0] -= p[2]
            room[1].append(p)
        for _, pieces in rooms:
            full += bins.close(pieces)
        yield _batch(full)

    return merge


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` ids.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, start (the document's ids
    before the piece), length, doc_tokens, sequence_id, offset (in the sequence, gapless from 0) and
    ids (the piece, little-endian unsigned 32-bit). A null text is empty and leaves the end id alone;
    a null doc_id stays null; a repeated row is packed as often as it comes, with equal lengths in the order of the rows of its task;
    a very long text is encoded whole and cut into as many sequences as it fills; an empty table gives none.
    """
    path = tokenizer or public_path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialize(rows.mapInArrow(_fill(path, end_id, capacity), SCHEMA), "packing")
    left = first.where(F.col("sequence_id").isNull()).withColumn("group", F.floor(F.col("worker") / GROUP).cast("long"))
    merged = left.groupBy("group").applyInArrow(_dropping_group(_merge(capacity)), SCHEMA)
    return first.where(F.col("sequence_id").isNotNull()).unionByName(merged).drop("class", "worker")


def _dropping_group(f):
    def call(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(key, (b.select(_ARROW.names) for b in batches))

    return call
