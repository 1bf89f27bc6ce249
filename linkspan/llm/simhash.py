"""Near-duplicates by SimHash fingerprints and pivot distance tables.

A fingerprint has a row of Hamming distances to ``PIVOTS`` reference fingerprints, made once. By the
triangle inequality, two fingerprints within ``radius`` bits have rows that differ by ``radius`` at most
in every coordinate; pairs that differ more are discarded, the others are verified bit by bit.

Distances of random fingerprints all lie near 32, so a whole row makes no key for a join. Hence rows
meet by blocks: 64 bits are cut into ``2 * radius`` blocks, of which fingerprints within ``radius``
share at least ``radius``; every choice of ``radius`` blocks is a key (20 keys of some 32 bits for a radius of 3).
Only distinct fingerprints take part. Within a key, tasks connect what is within the radius and give the
fewest links that keep it connected, not all pairs. The fingerprints of a crowded key are cut by blocks once more:
they agree on the key's blocks, so what they differ by lies in the other half, of whose blocks they again share
enough. A key with more than ``TILE`` fingerprints even so is dealt to tasks by pairs of tiles, which grow with the root of
the key's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialize, named_back, passing_schema, set_aside, settle
from .components import connected

PIVOTS = 16
TILE, LARGEST_TILE = 2048, 65536
#: Fingerprints of a key that are cut by further blocks.
CROWD = 4096
SMALL = 32
#: Reference fingerprints, from a fixed seed.
REFERENCES = np.random.default_rng(64).integers(0, 1 << 64, PIVOTS, dtype="u8")


def words_of(text: str | None) -> list[bytes]:
    """Words between \\x20 and \\x09-\\x0D, A-Z lower-cased; both are what bytes do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, words: int = 3) -> int:
    """Each bit is the majority of the XXH64 (seed 42) of all shingles, repeats included."""
    from xxhash import xxh64_intdigest

    found = words_of(text)
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    if n == 1:
        shingles = [b" ".join(found)]
    elif words == 3:
        shingles = map(b"%b %b %b".__mod__, zip(found, found[1:], found[2:]))
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    total, at = np.zeros(64, "i8"), 0
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), "u8", n)
    while at < n:
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
        at += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view("u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with ``print`` (the fingerprint as a signed long); it replaces a column of that name."""
    rows, schema = passing_schema(docs, ("print", LongType()))
    at = [c.lower() for c in rows.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [_signed(fingerprint(t.as_py(), words)) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.int64())], [*b.schema.names, "print"])

    return rows.mapInArrow(run, schema)


def blocks(radius: int) -> list[int]:
    """Masks of every choice of ``radius`` out of ``2 * radius`` blocks of 64 bits."""
    edges = [64 * i // (2 * radius) for i in range(2 * radius + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, radius)]


def further_blocks(mask: int, radius: int) -> list[int]:
    """Masks of every choice of ``radius`` out of ``2 * radius`` blocks of the bits outside ``mask``."""
    bits = [i for i in range(64) if not mask >> i & 1]
    edges = [len(bits) * i // (2 * radius) for i in range(2 * radius + 1)]
    parts = [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, radius)]


def distances(prints: np.ndarray) -> np.ndarray:
    """The pivot table: a row of distances for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype("i1")


def _table(radius: int):
    masks = np.array(blocks(radius), "u8")

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False).astype("i8").view("u8")
            rows = distances(p)
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            for k, m in enumerate(masks):
                # A key: the blocks' bits, spread by an odd factor, with the number of the choice.
                key = ((p & m) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)).view("i8")
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(p), k, "i4")), b.column(0), packed], ["key", "choice", "print", "distances"])

    return table


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of 0..n-1, the lowest one that the links (a, b) connect it with."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def _near(p, d, i, j, radius) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (i, j) within the radius: by the coordinates first, then by the bits."""
    for c in range(d.shape[1]):
        near = np.abs(d[i, c] - d[j, c]) <= radius
        i, j = i[near], j[near]
    near = np.bitwise_count(p[i] ^ p[j]) <= radius
    return i[near], j[near]


def _dense(p, d, left, right, radius) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius between two tiles (or in one), few at a time."""
    found_a, found_b = [], []
    for at in range(0, len(left), 64):
        part = left[at : at + 64]
        ok = np.ones((len(part), len(right)), bool)
        for c in range(d.shape[1]):
            ok &= np.abs(d[part, c][:, None] - d[right, c][None, :]) <= radius
        i, j = np.nonzero(ok)
        near = np.bitwise_count(p[part[i]] ^ p[right[j]]) <= radius
        i, j = part[i[near]], right[j[near]]
        low = _lowest(len(p), i, j)  # keep a spanning set of these alone
        used = np.flatnonzero(low != np.arange(len(p)))
        found_a.append(used)
        found_b.append(low[used])
    return np.concatenate(found_a), np.concatenate(found_b)


def _connect(radius: int):
    """Rows sorted by (key, cell) to links (a, b) of fingerprints."""

    def of(p, d, key, side) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[new, len(key)])
        a, b = [], []
        small = size <= SMALL
        number = np.repeat(np.arange(len(new)), size)
        inside = small[number]
        for lag in range(1, min(SMALL, size[small].max(initial=1))):
            i = np.flatnonzero(inside[:-lag] & inside[lag:] & (number[:-lag] == number[lag:]))
            x, y = _near(p, d, i, i + lag, radius)
            a.append(x)
            b.append(y)
        for g in np.flatnonzero(~small):
            rows = np.arange(new[g], new[g] + size[g])
            left, right = (rows[side[rows] != 2], rows[side[rows] != 1])
            if len(left) and len(right):
                x, y = _dense(p[rows], d[rows], left - rows[0], right - rows[0], radius)
                a.append(x + rows[0])
                b.append(y + rows[0])
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
        low = _lowest(len(p), a, b)
        used = np.flatnonzero(p[low] != p)
        links = np.unique(np.stack([p[used], p[low[used]]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0].view("i8")), pa.array(links[:, 1].view("i8"))], ["a", "b"])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cell = batch.column(1).to_numpy(zero_copy_only=False)
            p = batch.column(2).to_numpy(zero_copy_only=False).astype("i8").view("u8")
            d = np.frombuffer(b"".join(batch.column(3).to_pylist()), "i1").reshape(len(p), -1)
            side = batch.column(4).to_numpy(zero_copy_only=False)
            held.append((p, d, np.stack([key, cell], 1), side))
            p, d, k, side = (np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero((k[:-1] != k[1:]).any(1))
            done = last[-1] + 1 if len(last) else 0  # the last key may go on; it holds two tiles at most
            if done:
                yield of(p[:done], d[:done], _number(k[:done]), side[:done])
            held = [(p[done:], d[done:], k[done:], side[done:])]
        if held:
            p, d, k, side = held[0]
            yield of(p, d, _number(k), side)

    def _number(k: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[True, (k[1:] != k[:-1]).any(1)])

    return connect


def _again(radius: int):
    """Rows of crowded keys under the keys of further blocks; the numbers of these choices go on where the others end."""
    masks = blocks(radius)
    further = [further_blocks(m, radius) for m in masks]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            choice = b.column(0).to_numpy(zero_copy_only=False)
            p = b.column(1).to_numpy(zero_copy_only=False).astype("i8").view("u8")
            for k in np.unique(choice):
                at = np.flatnonzero(choice == k)
                rows = b.take(pa.array(at))
                for n, m in enumerate(further[k]):
                    number = len(masks) * (1 + n) + int(k)
                    key = ((p[at] & np.uint64(m | masks[k])) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number)).view("i8")
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(at), number, "i4")), rows.column(1), rows.column(2)], ["key", "choice", "print", "distances"])

    return again


_KEYED = "key long, choice int, print long, distances binary"


def _dealt(keyed: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """key, cell, print, distances, side: the rows of each key; of a large one, fingerprints fall into ``parts`` tiles, and each goes to
    the cells of its tile with every tile."""
    rows = keyed.join(sizes, ["key", "choice"])
    in_tile = F.least(F.greatest(F.ceil(F.sqrt("n") * 8), F.lit(tile)), F.lit(max(tile, LARGEST_TILE)))
    parts = F.ceil(F.col("n") / in_tile).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("tile", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    side = F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
    return rows.select(F.xxhash64("key", "choice").alias("key"), (low * F.col("parts") + high).alias("cell"), "print", "distances", side.alias("side"))


def cells(prints: DataFrame, radius: int = 3, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """key, cell, print, distances, side: which fingerprints are compared, those of side 1 with those of side 2 alone."""
    keyed = materialize(prints.mapInArrow(_table(radius), _KEYED), "pivot-table")
    sizes = materialize(keyed.groupBy("key", "choice").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    crowded = sizes.where(F.col("n") > crowd)
    found = _dealt(keyed, sizes.where(F.col("n") <= crowd), tile)
    if crowded.isEmpty():
        return found
    again = keyed.join(crowded.drop("n"), ["key", "choice"]).select("choice", "print", "distances").mapInArrow(_again(radius), _KEYED)
    again = materialize(again, "further-keys")
    return found.unionByName(_dealt(again, again.groupBy("key", "choice").agg(F.count("*").alias("n")).where("n > 1"), tile))


def links(prints: DataFrame, radius: int = 3, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints (column ``print``) that connect all within ``radius``."""
    rows = cells(prints, radius, tile, crowd).repartition("key", "cell").sortWithinPartitions("key", "cell", "print")
    return rows.mapInArrow(_connect(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with print (fingerprint), component_id (smallest doc_id reachable over links of at most
    ``radius`` bits, its own included) and keep (true for one row of each component).

    Null and empty texts and texts without words have fingerprint 0 and are linked like any other.
    A null doc_id is larger than all others: a component of null ids alone has component_id null. The row
    kept is the first of the smallest doc_id. Columns named print, component_id or keep are replaced, all others stay.
    Very long texts are taken whole; an empty table gives no rows.
    """
    kept, names = set_aside(docs, "doc_id", "text", replaced=("print", "component_id", "keep"))
    base = materialize(with_fingerprints(kept.withColumn("uid", F.monotonically_increasing_id()), words), "fingerprints")

    def by_print() -> DataFrame:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
        prints = materialize(base.groupBy("print").agg(first), "prints")
        found = connected(materialize(links(prints.select("print"), radius), "links"))  # node, component
        labelled = prints.join(found, prints["print"] == found["node"], "left").select("print", "first", F.coalesce("component", "print").alias("component"))
        lowest = labelled.groupBy("component").agg(F.min("first").alias("lowest"))
        joined = labelled.join(lowest, "component").select("print", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.uid").alias("kept_uid"))
        return joined

    joined = settle(docs.sparkSession, "components", by_print)
    return base.join(joined, "print").select(*named_back(names), "print", "component_id", (F.col("uid") == F.col("kept_uid")).alias("keep"))
