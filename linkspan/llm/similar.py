"""Near-duplicates by similarity of word shingles, discarded by SimHash pivot tables and verified exactly.

A radius of a few bits finds next to none of the texts that share 80 % of their shingles: they differ by
ten bits of 64 or so. This form hence lets rows of the pivot table meet by something else: the ``SKETCH``
smallest of a text's shingle hashes. Two texts of similarity 0.8 share at least ``SHARED`` of 24 in all but
one case of a million, so each needs to show only its ``24 - SHARED + 1`` rarest (prefix filtering, by
counts over all texts), and passages that many texts share don't bring them together. Texts of up to 24 shingles
are met without exception.

Pairs that meet are discarded by their sizes, by the largest difference of their rows of pivot distances, by their
own distance (texts of fewer than ``FEW`` shingles are spared these two, as their bits say little), and by sharing
fewer than ``SHARED`` hashes of their sketches. What is left is verified by the exact Jaccard similarity of all
shingles. To give no quadratic number of pairs for a large group, each key first links its texts to the one whose
sketch is shared most; pairs of a key are then compared only across the components that these links leave apart.
Where many texts of a key stay apart, they are dealt by bands of sizes, of which only neighbouring ones can hold
similar texts, and within these by tiles that grow with the root of a band's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, named_back, set_aside, settle
from .components import connected
from .simhash import distances, words_of

SKETCH = 24
SHARED = 9
#: Bits that two texts of similarity 0.8 may differ by: about ten on average, with a deviation of three; so more
#: than these in one case of five million. Texts of few shingles vary more and are not compared by bits.
RADIUS = 26
FEW = 64
#: Texts of a key that make a tile, at least and at most.
TILE, LARGEST_TILE = 128, 4096


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The distinct shingles of A-Z lower-cased words; a shorter text is one shingle, none has none."""
    found = words_of(text)
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def jaccard(a: set, b: set) -> float:
    """Similarity of two sets; two empty ones are equal."""
    return len(a & b) / len(a | b) if a or b else 1.0


_ROWS = "uid long, print long, distances binary, n long, digest long, sketch array<long>"
_NO_KEY = np.iinfo("i8").max


def _sketch(words: int):
    from xxhash import xxh64_intdigest

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, n, digests, keys = [], [], [], []
            for t in b.column(1):
                h = np.unique(np.array([xxh64_intdigest(s, 42) for s in shingles(t.as_py(), words)], "u8"))
                bits = np.zeros(64, "i8")
                for at in range(0, len(h), 65536):
                    bits += np.unpackbits(h[at : at + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
                prints.append(np.packbits(2 * bits > len(h), bitorder="little").view("i8")[0])
                n.append(len(h))
                digests.append(np.array([xxh64_intdigest(h.tobytes(), 1)], "u8").view("i8")[0])
                keys.append(h[:SKETCH].view("i8") if len(h) else np.zeros(1, "i8"))
            rows = distances(np.array(prints, "i8").view("u8"))  # the pivot table
            columns = [b.column(0), pa.array(prints, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(n, pa.int64()), pa.array(digests, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "print", "distances", "n", "digest", "sketch"])

    return sketch


def _u8(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype("i8").view("u8")


def _pivots(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "i1").reshape(len(column), -1)


def _sketches(column) -> np.ndarray:
    """Rows of ``SKETCH`` keys; shorter ones are filled with the largest number."""
    keys = np.full((len(column), SKETCH), _NO_KEY)
    for row, k in enumerate(column.to_pylist()):
        keys[row, : len(k)] = k
    return keys


def _share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of sketches share as many keys as similar texts do."""
    out = np.empty(len(x), bool)
    for at in range(0, len(x), 10_000):
        a, b = x[at : at + 10_000], y[at : at + 10_000]
        both = ((a[:, :, None] == b[:, None, :]) & (a != _NO_KEY)[:, :, None]).sum((1, 2))
        size = np.minimum((a != _NO_KEY).sum(1), (b != _NO_KEY).sum(1))
        out[at : at + 10_000] = both >= np.maximum(1, -(-size * SHARED // SKETCH))
    return out


def _close(r: dict, x: np.ndarray, y: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """Places of the pairs of rows (x, y) that survive: by sizes, by rows of pivot distances, by bits, by sketches."""
    p, d, n = r["print"], r["distances"], r["n"]
    at = np.flatnonzero(np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]))
    most = np.where(np.minimum(n[x], n[y]) < FEW, 64, radius)
    for c in range(d.shape[1]):
        at = at[np.abs(d[x[at], c] - d[y[at], c]) <= most[at]]
    at = at[np.bitwise_count(p[x[at]] ^ p[y[at]]) <= most[at]]
    return at[_share(r["sketch"][x[at]], r["sketch"][y[at]])]


def _discard(similarity: float, radius: int):
    def discard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = {"print": _u8, "distances": _pivots, "sketch": _sketches, "n": lambda c: c.to_numpy(zero_copy_only=False)}
                r = {c: np.concatenate([f(b.column(f"{c}_a")), f(b.column(f"{c}_b"))]) for c, f in both.items()}
                at = _close(r, np.arange(b.num_rows), np.arange(b.num_rows) + b.num_rows, similarity, radius)
                yield b.select(["a", "b"]).take(pa.array(at))

    return discard


def _verify(similarity: float, words: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(shingles(s.as_py(), words), shingles(t.as_py(), words)) >= similarity for s, t in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Pairs (a, b) whose texts (uid, text) are similar. Only texts that a pair needs are moved."""
    pairs = materialize(pairs.distinct(), "pairs")
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "needed")
    texts = materialize(_of(texts, needed), "pair-texts")
    side = lambda c, text: texts.select(F.col("uid").alias(c), F.col("text").alias(text)).hint("merge")
    both = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b")
    return both.select("a", "b", "s", "t").mapInArrow(_verify(similarity, words), "a long, b long")


def _sets(words: int):
    from xxhash import xxh64_intdigest

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashed = [np.unique(np.array([xxh64_intdigest(s, 42) for s in shingles(t.as_py(), words)], "u8")).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashed, pa.binary())], ["uid", "hashes"])

    return sets


_CELL = ("key", "cell", "uid", "component", "side", "n", "print", "distances", "sketch", "keys")


def _first_common(k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest key that both texts of each pair show; padding is the largest number."""
    out = np.empty(len(x), "i8")
    for at in range(0, len(x), 20_000):
        a, b = k[x[at : at + 20_000], :, None], k[y[at : at + 20_000], None, :]
        out[at : at + 20_000] = np.where(a == b, a, _NO_KEY).min((1, 2))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The columns of each (key, cell) of batches sorted by them; a cell has two tiles of texts at most."""
    held: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        rows: dict = {c: b.column(c).to_numpy(zero_copy_only=False) for c in _CELL[:6]}
        rows |= {"print": _u8(b.column("print")), "distances": _pivots(b.column("distances")), "sketch": _sketches(b.column("sketch")), "keys": _sketches(b.column("keys"))}
        if "hashes" in b.schema.names:
            rows["hashes"] = np.array([*b.column("hashes").to_pylist(), None], object)[:-1]
        rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()} if held else rows
        k, c = rows["key"], rows["cell"]
        ends = np.flatnonzero((k[:-1] != k[1:]) | (c[:-1] != c[1:])) + 1
        for a, z in zip(np.r_[0, ends], ends):  # the last cell may go on
            yield {c: v[a:z] for c, v in rows.items()}
        held = {c: v[ends[-1] if len(ends) else 0 :] for c, v in rows.items()}
    if held:
        yield held


def _surviving(r: dict, similarity: float, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell, across components, that are not discarded, each under the first key that it has in common alone."""
    i, j = np.flatnonzero(r["side"] != 2), np.flatnonzero(r["side"] != 1)
    uid, component = r["uid"], r["component"]
    for at in range(0, len(i), 64):
        x, y = (v.ravel() for v in np.broadcast_arrays(i[at : at + 64, None], j[None, :]))
        ok = (component[x] != component[y]) & ((r["side"][x] != 0) | (uid[x] < uid[y]))
        x, y = x[ok], y[ok]
        near = _close(r, x, y, similarity, radius)
        x, y = x[near], y[near]
        ok = _first_common(r["keys"], x, y) == r["key"][x]
        yield x[ok], y[ok]


def _meeting(similarity: float, radius: int):
    """The texts of each cell that have a surviving partner in it: no pairs, at most the texts themselves."""

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _cells(batches):
            hit = np.zeros(len(r["uid"]), bool)
            for x, y in _surviving(r, similarity, radius):
                hit[x] = hit[y] = True
            yield pa.RecordBatch.from_arrays([pa.array(r[c][hit]) for c in _CELL[:5]], list(_CELL[:5]))

    return meeting


def _across(similarity: float, radius: int):
    """Verified links between the components of each cell; texts that links have connected are compared no more."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _cells(batches):
            sets, uid, n, component = [np.frombuffer(h, "u8") for h in r["hashes"]], r["uid"], r["n"], r["component"].tolist()
            low, links = {c: c for c in component}, []

            def root(c: int) -> int:
                while low[c] != c:
                    low[c] = low[low[c]]
                    c = low[c]
                return c

            for x, y in _surviving(r, similarity, radius):
                near = np.argsort(np.bitwise_count(r["print"][x] ^ r["print"][y]), kind="stable")
                for a, b in zip(x[near].tolist(), y[near].tolist()):
                    if root(component[a]) != root(component[b]):
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if both >= similarity * (n[a] + n[b] - both):
                            low[root(component[a])] = root(component[b])
                            links.append((uid[a], uid[b]))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return across


#: Rows of numbers of texts that may be broadcast (about 50 bytes each); more are shuffled.
BROADCAST_ROWS = 1_000_000


def _of(texts: DataFrame, uids: DataFrame) -> DataFrame:
    """The rows of ``texts`` (uid, text) of a written table of uids."""
    return texts.join(broadcast_if_small(uids, uids.count(), BROADCAST_ROWS), "uid")


def _dealt_out(rest: DataFrame, similarity: float, tile: int) -> DataFrame:
    """``rest`` (key, uid, n, size: how many rows the key has, and more) with cell and side: each two rows of a key
    whose sizes allow the similarity meet in one cell, rows of side 1 only rows of side 2.

    A key of up to ``tile`` rows is one band; else a band holds sizes within the similarity of each other, so that
    only rows of one band or of neighbouring ones can be similar. A band's rows are dealt to tiles, and each goes to
    the cells of its tile with every tile of its own and of both neighbouring bands; rows without any other are dropped.
    """
    width = math.log(1 / similarity) + 1e-6 if similarity < 1 else 1.0
    rest = rest.withColumn("band", F.when(F.col("size") > tile, F.floor(F.log(F.greatest("n", F.lit(1))) / width)).otherwise(0).cast("int"))
    bands = rest.groupBy("key", "band").agg(F.count("*").alias("rows"))
    in_tile = F.least(F.greatest(F.ceil(F.sqrt("rows") * 8), F.lit(tile)), F.lit(max(tile, LARGEST_TILE)))
    bands = bands.withColumn("parts", F.ceil(F.col("rows") / in_tile).cast("int"))
    order = Window.partitionBy("key").orderBy("band")  # a row for each band: few
    beside = lambda f, step: F.coalesce(F.when(f("band").over(order) == F.col("band") + step, f("parts").over(order)), F.lit(0))
    bands = bands.withColumns({"above": beside(F.lead, 1), "below": beside(F.lag, -1)}).where("rows > 1 or above > 0 or below > 0")
    rest = rest.join(materialize(bands.drop("rows"), "bands"), ["key", "band"])
    rest = rest.withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    cell = lambda band, kind, i, j: F.xxhash64(band, F.lit(kind), i, j).alias("cell")
    side = lambda o: F.when(F.col("tile") == o, 0).when(F.col("tile") < o, 1).otherwise(2).alias("side")
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(up_to("parts"), lambda o: F.struct(cell(F.col("band"), 0, F.least("tile", o), F.greatest("tile", o)), side(o)))
    above = F.transform(up_to("above"), lambda o: F.struct(cell(F.col("band"), 1, F.col("tile"), o), F.lit(1).alias("side")))
    below = F.transform(up_to("below"), lambda o: F.struct(cell(F.col("band") - 1, 1, o, F.col("tile")), F.lit(2).alias("side")))
    rest = rest.withColumn("at", F.explode(F.concat(own, above, below)))
    return rest.withColumns({"cell": F.col("at.cell"), "side": F.col("at.side")}).drop("at", "tile", "parts", "above", "below", "band")


def similar_groups(texts: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """uid, component (smallest uid of its group) of each row of ``texts`` (uid, text).

    Groups are connected by texts of at least ``similarity``. Texts without words are equal. Texts of equal
    shingles are one class and only its smallest uid takes part in the search.
    """
    rows = materialize(texts.mapInArrow(_sketch(words), _ROWS), "sketches")
    of_class = F.min(F.struct("uid", "distances", "sketch")).alias("m")
    classes = materialize(rows.groupBy("digest", "n", "print").agg(of_class).select("digest", "n", "print", "m.*"), "classes")
    keys = materialize(classes.select("uid", F.explode("sketch").alias("key")), "sketch-keys")
    # Tables on both sides of joins by key let adaptive execution split a key that a third of all rows show.
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("seen")).where("seen > 1"), "common-keys")
    ranked = keys.join(counts.hint("merge"), "key", "left").select("uid", "key", F.coalesce("seen", F.lit(1)).alias("seen"))
    ranked = ranked.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("seen", "key"))).alias("k"))  # SKETCH at most
    need = F.greatest(F.lit(1), F.ceil(F.size("k") * (SHARED / SKETCH))).cast("int")
    weight = F.aggregate("k", F.lit(0).cast("long"), lambda t, x: t + x["seen"]).alias("weight")
    shown = ranked.select("uid", weight, F.explode(F.slice("k", F.lit(1), F.size("k") - need + 1)).alias("k")).where("k.seen > 1").select("uid", "weight", "k.key")
    shown = materialize(shown, "shown-keys")
    # Each key's texts with the one among them whose sketch most others share: of copies with edits, the unedited one.
    lead = shown.groupBy("key").agg(F.max_by("uid", F.struct("weight", -F.col("uid"))).alias("b"), F.count("*").alias("size")).where("size > 1")
    pairs = shown.join(materialize(lead, "leads").hint("merge"), "key").where("uid <> b").select(F.col("uid").alias("a"), "b").distinct()
    facts = classes.select("uid", "print", "distances", "sketch", "n")
    side = lambda c: facts.select(F.col("uid").alias(c), *[F.col(f).alias(f"{f}_{c}") for f in ("print", "distances", "sketch", "n")])
    met = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    first = materialize(_verified(met.mapInArrow(_discard(similarity, radius), "a long, b long"), texts, similarity, words), "leader-links")
    joined = connected(first)
    # What these links leave apart, key by key.
    rest = shown.join(joined.withColumnRenamed("node", "uid"), "uid", "left").select("key", "uid", F.coalesce("component", "uid").alias("component"))
    rest = materialize(rest, "apart")
    many = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size")
    rest = materialize(rest.join(materialize(many, "apart-keys"), "key"), "apart-rows")
    own = rest.groupBy("uid").agg(F.collect_list("key").alias("keys"))  # SKETCH at most
    about = materialize(own.join(facts, "uid"), "apart-texts")
    cells = _dealt_out(rest.join(about.select("uid", "n"), "uid"), similarity, tile).select("key", "cell", "uid", "component", "side")

    def together(rows: DataFrame, about: DataFrame, *more: str) -> DataFrame:
        return rows.join(about.hint("merge"), "uid").select(*_CELL, *more).repartition("key", "cell").sortWithinPartitions("key", "cell", "uid")

    met = together(cells, about).mapInArrow(_meeting(similarity, radius), "key long, cell long, uid long, component long, side int")
    met = materialize(met, "meeting")
    needed = materialize(met.select("uid").distinct(), "meeting-texts")
    hashes = materialize(_of(texts, needed).select("uid", "text").mapInArrow(_sets(words), "uid long, hashes binary"), "meeting-sets")
    links = together(met, about.join(hashes, "uid"), "hashes").mapInArrow(_across(similarity, radius), "a long, b long")
    second = materialize(links.distinct(), "other-links")
    found = connected(first.unionByName(second))
    grouped = classes.join(found.withColumnRenamed("node", "uid"), "uid", "left").select("digest", "n", "print", F.coalesce("component", "uid").alias("component"))
    return rows.select("uid", "digest", "n", "print").join(grouped, ["digest", "n", "print"]).select("uid", "component")


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` with component_id (smallest doc_id of its group) and keep (true for one row of each group).

    Nulls and repeated rows are as in ``near_duplicates``: a null text is empty, texts without words form
    one group, a null doc_id is larger than all others, the row kept is the first of the smallest doc_id.
    Columns named component_id or keep are replaced, all others stay. Very long texts are taken whole; an
    empty table gives no rows.
    """
    kept, names = set_aside(docs, "doc_id", "text", replaced=("component_id", "keep"))
    base = materialize(kept.withColumn("uid", F.monotonically_increasing_id()), "similar")

    def labels() -> DataFrame:
        groups = similar_groups(base.select("uid", F.col("text").cast("string").alias("text")), similarity, words)
        placed = materialize(groups.join(base.select("uid", "doc_id"), "uid"), "groups")
        lowest = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("lowest"))
        lowest = materialize(lowest, "lowest")
        return placed.select("uid", "component").join(lowest, "component").select("uid", F.col("lowest.doc_id").alias("component_id"), (F.col("uid") == F.col("lowest.uid")).alias("keep"))

    labelled = settle(docs.sparkSession, "similar-labels", labels)
    return base.join(broadcast_if_small(labelled, labelled.count(), BROADCAST_ROWS), "uid").select(*named_back(names), "component_id", "keep")
