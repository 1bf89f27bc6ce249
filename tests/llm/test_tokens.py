from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkspan.llm import id_store, packing
from linkspan.llm.token_counts import count_tokens, tokenizer_digest
from linkspan.llm.tokens import ALPHABET, Encoder, public_path

ODD = ["", " ", "\n\n  x", "It's 2024's  they've", "Ünïcödé ñandú ß", "İstanbul ŉ", "漢字 кириллица 🙂", "<|endoftext|> a", "<|startoftext|>", "a\x00b", "don'T", "x" * 3000, "  wide", "é", "½ ² Ⅷ ٣"]
DOCS = [*enumerate(ODD), (50, None), (None, "null id"), (51, "copy"), (51, "copy"), (52, "long text of words " * 8000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    enc, library = Encoder(public_path(name)), Tokenizer.from_file(public_path(name))
    r = random.Random(8)
    texts = [*ODD, "".join(ALPHABET), " ".join(ALPHABET), "a".join(ALPHABET)]
    texts += ["".join(r.choice(ALPHABET[: r.choice([60, 100, 500])]) for _ in range(r.choice([1, 5, 50]))) for _ in range(2000)]
    assert enc.pieces is not None
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == want.ids, t


def test_encoder_without_a_known_pattern(tmp_path):
    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    from tokenizers.pre_tokenizers import ByteLevel

    t.pre_tokenizer = ByteLevel(add_prefix_space=True)
    t.save(str(tmp_path / "own.json"))
    enc = Encoder(str(tmp_path / "own.json"))
    assert enc.pieces is None and enc.count("hello there") == len(t.encode("hello there").ids)


def ids_of(text):
    return [*Tokenizer.from_file(public_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 1]


def test_counts(spark, docs, tmp_path):
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in DOCS), key=repr)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        rows = count_tokens(docs, cache_path=cache).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in DOCS})  # the second time nothing is encoded
    other = count_tokens(docs, tokenizer=public_path("word_bpe_49k.json"), cache_path=cache)
    assert other.where("doc_id = 51").first().n_tokens == len(ids_of("copy")) - 1
    assert count_tokens(docs.where("false")).count() == 0
    assert count_tokens(docs.withColumns({"n_tokens": F.lit(9), "content_digest": F.lit("x")})).where("doc_id = 0").first().n_tokens == 0


@pytest.mark.parametrize("bits", [False, True])
def test_store_round_trip(spark, docs, bits, tmp_path):
    id_store.write_ids(docs, str(tmp_path / "s"), bits=bits)
    rows = sorted(id_store.read_ids(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    order = sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in order]
    at = 0
    for r, (_, t) in zip(rows, order):
        want = ids_of(t)
        assert (r.start, r.n_tokens) == (at, len(want)) and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)


def test_store_many_chunks(spark, tmp_path, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("number"), F.col("id").cast("string")).alias("text")).repartition(7)
    id_store.write_ids(docs, str(tmp_path / "s"))
    rows = sorted(id_store.read_ids(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(500))
    assert id_store.store_round_trip(docs.where("false")).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 20000])
def test_planes_of_blocks(n, bits, monkeypatch):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype="u4")
    planes, ends = id_store.to_blocks(ids, bits)
    n_blocks = -(-n // id_store.BLOCK)
    assert len(ends) == n_blocks * (32 if bits else 4) and (ends[-1] if ends else 0) == len(planes)
    assert (id_store.from_blocks(planes, ends, n, bits) == ids).all()
    read, whole = [], id_store.from_block
    monkeypatch.setattr(id_store, "from_block", lambda p, k, b: read.append(k) or whole(p, k, b))
    for a, z in ((0, 1), (4095, 4097), (5000, 5000), (n // 2, n), (4096, 8192), (n - 1, n + 5)):
        read.clear()
        a, z = max(a, 0), max(z, 0)
        assert (id_store.from_blocks(planes, ends, n, bits, a, z) == ids[a:z]).all()
        assert len(read) == (-(-min(z, n) // 4096) - a // 4096 if a < min(z, n) else 0)  # no block beside the range
    if n == 20000:  # the size of blocks matters
        monkeypatch.setattr(id_store, "BLOCK", 16)
        other, more = id_store.to_blocks(ids, bits)
        assert other != planes and len(more) == 1250 * (32 if bits else 4) and (id_store.from_blocks(other, more, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_ranges_and_long_documents(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(id_store, "CHUNK", 5000)
    texts = [(i, f"number {i} " * (i % 7)) for i in range(40)] + [(12, "word " * 23_000), (13, None), (None, "null " * 6000)]
    path = str(tmp_path / "s")
    id_store.write_ids(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), path, bits=bits)
    chunks = spark.read.schema(id_store.SCHEMA).parquet(path).collect()
    assert max(r.n_ids for r in chunks) <= 5000 and sum(r.doc_lengths[0] < r.doc_totals[0] for r in chunks) >= 7
    assert all(len(r.ends) == -(-r.n_ids // 4096) * (32 if bits else 4) for r in chunks)
    rows = sorted(id_store.read_ids(spark, path).collect(), key=lambda r: r.start)
    whole = b"".join(r.ids for r in rows)
    want = [(d, ids_of(t)) for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))]
    assert sorted((r.doc_id is not None, r.doc_id or 0, len(r.ids) // 4, r.n_tokens) for r in rows) == sorted((d is not None, d or 0, len(i), len(i)) for d, i in want)
    assert [r.start for r in rows] == np.cumsum([0, *[len(r.ids) // 4 for r in rows[:-1]]]).tolist()
    for a, z in ((0, 10), (5990, 6010), (7000, 19000), (len(whole) // 4 - 3, len(whole) // 4 + 9), (50, 50)):
        pieces = sorted(id_store.read_range(spark, path, a, z).collect(), key=lambda r: r.doc_start + r.piece_start)
        assert b"".join(p.ids for p in pieces) == whole[4 * a : 4 * z]
        assert [p.doc_start + p.piece_start for p in pieces] == [a + sum(len(q.ids) // 4 for q in pieces[:i]) for i in range(len(pieces))]
    pieces = id_store.read_pieces(spark, path).collect()
    assert max(len(p.ids) for p in pieces) <= 4 * 5000 and sum(len(p.ids) for p in pieces) == len(whole)


def test_a_document_of_ten_million_ids_in_bounded_memory():
    """Chunk by chunk: no array but those of one chunk is held at once."""
    import tracemalloc

    import pyarrow as pa

    ids = (np.arange(10_000_000, dtype="u4") % 50_000).tobytes()

    class Fake:
        def ids(self, text):
            return ids

    original, id_store.encoder = id_store.encoder, lambda path: Fake()
    context, id_store.TaskContext = id_store.TaskContext, type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))})
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"])], ["doc_id", "text"])
        tracemalloc.start()
        n = seen = 0
        for chunk in id_store._encode("", 1, False, id_store.CHUNK)(iter([batch])):
            for piece in id_store._decode(iter([chunk.append_column("base", pa.array([n]))])):
                seen += len(piece.column(4)[0].as_py()) // 4
            n += chunk.column(3)[0].as_py()
            tracemalloc.reset_peak() if n < 3 * id_store.CHUNK else None
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        id_store.encoder, id_store.TaskContext = original, context
    assert n == seen == 10_000_001
    assert peak < 60e6  # the text's own ids are 40 MB, a chunk's are 1 MB


def check_packing(rows, docs, capacity):
    per_doc, per_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id, r.doc_tokens].append(r)
        per_bin[r.sequence_id].append(r)
    for pieces in per_bin.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) <= capacity
    total = sorted(zlib.crc32(np.array(ids_of(t), "<u4").tobytes()) for _, t in docs)
    whole = []
    for (d, n), pieces in per_doc.items():
        copies = sum(p.start == 0 for p in pieces)
        pieces.sort(key=lambda r: r.start)
        if copies == 1:
            assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))] and sum(p.length for p in pieces) == n
            whole.append(zlib.crc32(b"".join(p.ids for p in pieces)))
        else:
            whole += [zlib.crc32(p.ids) for p in pieces]
    assert sorted(whole) == total
    return len(per_bin)


def test_packing(spark, docs):
    check_packing(packing.pack_documents(docs).collect(), DOCS, 2048)
    assert packing.pack_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_packing_any_capacity(spark, capacity):
    r = random.Random(9)
    docs = [(i, "w " * r.choice([0, 1, 5, 30, 100, 700])) for i in range(60)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), capacity=capacity).collect()
    bins = check_packing(rows, docs, capacity)
    assert bins * capacity <= 1.25 * sum(r.length for r in rows) + 4 * capacity


def test_cuts():
    for n in [*range(1, 5000, 7), 10**6]:
        pieces = list(packing.cuts(n, 2048))
        assert sum(m for _, m in pieces) == n and all(0 < m <= 2048 // k for k, m in pieces)


def test_a_large_foreign_cache_is_not_gone_through(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    foreign = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("content_digest"), F.lit(-7).cast("long").alias("n_tokens"))
    version = tokenizer_digest(public_path("byte_bpe_50k.json"))
    for v, rows in (("another", foreign), (version, foreign.limit(2000))):
        rows.withColumn("tokenizer_digest", F.lit(v)).write.partitionBy("tokenizer_digest").mode("append").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, cache_path=cache).collect()}
    assert got == {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    assert spark.read.parquet(cache).count() == 7000 + len({t or "" for _, t in DOCS})
    hit = docs.where("doc_id = 51").limit(1).select(F.unhex(F.sha2("text", 256)).alias("content_digest"), F.lit(99).cast("long").alias("n_tokens"))
    hit.withColumn("tokenizer_digest", F.lit(version)).write.partitionBy("tokenizer_digest").parquet(str(tmp_path / "known"))
    assert {r.n_tokens for r in count_tokens(docs.where("doc_id = 51"), cache_path=str(tmp_path / "known")).collect()} == {99}  # taken from the cache


def test_decoded_ids_are_not_shuffled(spark, docs, tmp_path):
    id_store.write_ids(docs, str(tmp_path / "s"))
    plan = id_store.read_ids(spark, str(tmp_path / "s"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0] and "BroadcastHashJoin" in plan.split("MapInArrow")[1]


def test_one_id_with_many_rows_is_dealt_out(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    id_store.write_ids(rows, str(tmp_path / "s"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    chunks = spark.read.parquet(str(tmp_path / "s")).select("shard", F.size("doc_ids").alias("n")).groupBy("shard").sum("n").collect()
    assert max(r[1] for r in chunks) < 1500 and sum(r[1] for r in chunks) == 3000
    got = id_store.read_ids(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 1000 + [i for i in range(3000) if i % 3]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(3000)]


def test_clashing_columns(spark, docs):
    extra = {c: F.lit("other") for c in ("uid", "row", "ids", "start", "shard", "class", "worker", "group", "offset", "n_tokens", "first", "base")}
    more = docs.withColumns(extra)
    plain = sorted((r.start, r.n_tokens, bytes(r.ids)) for r in id_store.store_round_trip(docs).collect())
    assert sorted((r.start, r.n_tokens, bytes(r.ids)) for r in id_store.store_round_trip(more).collect()) == plain
    check_packing(packing.pack_documents(more).collect(), DOCS, 2048)
