"""Secret scans, in DataFrame functions alone.

Three patterns give the base spans. Beside them, runs of token characters are judged by two Markov
models over characters, one of random strings and one of ordinary identifiers: a run whose mean
log-likelihood ratio exceeds a threshold is a span too. Both models are counted from labelled samples;
the ratio of every pair of characters is a table of fixed size, which goes into the query as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length of it.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # runs of under 16 characters hold no longer one
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
KINDS = (*(b[0] for b in BASE), "random")
#: Characters of a run: codes from FIRST on, in a table SIDE wide.
FIRST, SIDE = 43, 80
RUN = "[A-Za-z0-9+/_=-]"
#: Words that programmers' names are made of, for samples of ordinary identifiers.
NAME_WORDS = """account action address array average batch browser buffer button cache callback channel client column
command config content context controller count create current data default delete document element error event factory
field file filter format function group handler header height index input instance interface item key language length
level line list manager message method model module name network node number object option order output package page
parent parser password path pattern process product property query queue record region request resource response result
schema search section server service session setting source start state status stream string struct system table target
template test thread time title token type update user value vector version view width window worker""".split()


def random_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """text, label 1: ``n`` strings drawn by SHA-256 over letters and digits, base 64, hexadecimal and capitals."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(F.concat(digest, F.substring(F.sha2(digest, 256), 1, 32))))
    kind = F.col("id") % 4
    text = F.when(kind == 0, F.regexp_replace(b64, "[+/=]", "")).when(kind == 1, b64).when(kind == 2, F.substring(digest, 1, 40))
    return spark.range(n).select(F.substring(text.otherwise(F.upper(F.translate(b64, "+/=", "xyz"))), 1, 48).alias("text"), F.lit(1).alias("label"))


def name_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """text, label 0: ``n`` names of three words each, in camel case, snake case, with hyphens or as paths."""
    words = F.array(*map(F.lit, NAME_WORDS))
    pick = [F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(NAME_WORDS))).cast("int")) for k in range(3)]
    kind = F.col("id") % 4
    text = F.when(kind == 0, F.concat(pick[0], F.initcap(pick[1]), F.initcap(pick[2]))).when(kind == 1, F.concat_ws("_", *pick))
    return spark.range(n).select(text.when(kind == 2, F.concat_ws("-", *pick)).otherwise(F.concat_ws("/", *pick)).alias("text"), F.lit(0).alias("label"))


def corpus_samples(docs: DataFrame, recurring: int = 2) -> DataFrame:
    """text, label 0, weight: the distinct words of eight and more characters outside base spans, of all documents.

    A word must come ``recurring`` times at least (most secrets come once) and weighs the logarithm of how often it
    does, so that neither a text that a third of the rows share nor a frequent word is the whole sample. Words are
    added up in each task first; the longest runs are cut into pieces of 64 characters.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for _, pattern, _, _ in BASE:
        texts = texts.select(F.regexp_replace("text", pattern, " ").alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{8,64}})"), F.lit(1))).alias("text"))
    words = words.groupBy("text").agg(F.count("*").alias("n")).where(F.col("n") >= recurring)
    return words.select("text", F.lit(0).alias("label"), F.log2(F.col("n") + 1).alias("weight"))


def fit_ratio(samples: DataFrame, backing: float = 5.0) -> list[float]:
    """log P(next | character, label 1) - log P(next | character, label 0) for every pair of characters,
    from samples (text, label, and a weight where there is one, else 1); nulls and other labels don't count. Each transition
    is backed by the character's overall share with a weight of ``backing``. Without samples, all are zero."""
    weight = F.coalesce(F.col("weight").cast("double") if "weight" in samples.columns else F.lit(None), F.lit(1.0)).alias("weight")
    codes = samples.where(F.col("label").isin(0, 1) & (F.length("text") > 1)).select("label", weight, _codes(F.col("text")).alias("c"))
    pairs = codes.select("label", "weight", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    pairs = pairs.select("label", "weight", "p.a", "p.b").where(F.col("a").between(0, SIDE - 1) & F.col("b").between(0, SIDE - 1))
    rows = pairs.groupBy("label", "a", "b").agg(F.sum(F.col("weight").cast("decimal(20,6)")).cast("double").alias("n")).collect()  # at most 2 * SIDE ** 2
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in rows}
    used = [i for i in range(SIDE) if chr(FIRST + i).isalnum() or chr(FIRST + i) in "+/_=-"]
    logs = []
    for label in (0, 1):
        seen = [0.5 + sum(counts.get((label, a, b), 0) for a in used) for b in used]
        share = [x / sum(seen) for x in seen]
        rows = {a: [counts.get((label, a, b), 0) for b in used] for a in used}
        logs.append({a: [math.log((n + backing * s) / (sum(row) + backing)) for n, s in zip(row, share)] for a, row in rows.items()})
    table = [0.0] * (SIDE * SIDE)
    for a in used:
        for b, ordinary, strange in zip(used, logs[0][a], logs[1][a]):
            table[a * SIDE + b] = strange - ordinary
    return table


def _codes(run: Column) -> Column:
    """The code of each character, from ``FIRST`` on."""
    return F.transform(F.split(run, ""), lambda ch: F.ascii(ch) - FIRST)


def _ratio(run: Column, table: Column) -> Column:
    """Mean log-likelihood ratio over the pairs of a run, in one pass over its characters."""
    c, n = _codes(run), F.length(run) - 1
    each = F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.get(table, a * SIDE + b))
    return F.aggregate(each, F.lit(0.0), lambda t, x: t + x) / n


#: Stands around matches while a text is cut; where a text has it itself, another character takes its place.
_SIDE, _INSTEAD = "\ufdd0", "\ufffd"


def _found(text: Column, kind: int, pattern: str, verdict) -> Column:
    """kind, skip (code points between the match before and this one), len, ok: one search of the text for all matches."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_SIDE}$0{_SIDE}"))
    row = lambda gap, m: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("skip"), F.length(m).alias("len"), verdict(m).alias("ok"))

    def cut(parts: Column) -> Column:  # gap, match, gap, match, ..., gap
        gaps, matches = (F.filter(parts, lambda _, i: i % 2 == k) for k in (0, 1))
        return F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, row)

    return F.flatten(F.transform(F.array(F.split(marked, _SIDE, -1)), cut))


def scan_secrets(docs: DataFrame, ratio: list[float], threshold: float = 1.5, least: int = 16) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind. A run of at least
    ``least`` token characters is a span of kind random if its mean log-likelihood ratio is at least ``threshold``
    and it overlaps no base span. A null or empty text has none; null ids and repeated rows each keep their
    row; very long texts are searched whole; other columns are ignored; an empty table gives no rows. Each text is
    searched once a pattern, and only places of matches are shuffled.
    """
    table = F.from_json(F.lit("[" + ",".join(f"{x:.4f}" for x in ratio) + "]"), "array<double>")
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_SIDE), F.lit(_INSTEAD))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), text.alias("text"))

    def long_enough(pattern: str, group: int, least: int):
        return lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m) >= least

    found = [_found(F.col("text"), k, p, long_enough(p, g, n)) for k, (_, p, g, n) in enumerate(BASE)]
    found.append(_found(F.col("text"), len(BASE), f"{RUN}{{{least},}}", lambda m: _ratio(m, table) >= threshold))
    each = rows.select("uid", "doc_id", F.posexplode_outer(F.concat(*found)).alias("at", "m")).select("uid", "doc_id", "at", "m.*").repartition("uid")
    so_far = Window.partitionBy("uid", "kind").orderBy("at")
    spans = each.withColumn("end", F.sum(F.col("skip") + F.col("len")).over(so_far)).withColumn("start", F.col("end") - F.col("len"))
    spans = spans.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in ("kind", "start", "end")})
    base = F.col("kind") < len(BASE)
    by_start = Window.partitionBy("uid").orderBy("start", "kind")
    left = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.withColumns({"left": left, "right": right})
    alone = (F.coalesce("left", F.lit(-1)) <= F.col("start")) & (F.coalesce("right", F.col("end")) >= F.col("end"))
    spans = spans.withColumn("kind", F.when(base | alone, F.col("kind")))
    place = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    out = spans.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.array_sort(F.collect_list(place)).alias("found"),
    )
    names = F.array(*map(F.lit, KINDS))
    text = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, text), ",")
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS],
        F.sha2(joined(F.filter("found", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
