"""Removal of repeated passages by content-defined line chunks, in DataFrame functions alone.

Each line has a hash, and a rolling hash runs over the hashes of two lines. Its bits choose where a chunk that
starts at a line ends, in ``FAMILIES`` independent ways: at the next line whose bit of that family is set, after five
lines at most. So a chunk's end depends on the lines of the chunk alone, and a passage is cut alike wherever it
stands. A chunk has two to five lines; a line of ``LONG`` words or more is a chunk of its own too. Of chunks that
repeat anywhere, in one document or over all, the first by doc_id and place stays; the others go once their bytes
were compared.

Chosen ends miss one passage of two lines in sixteen. The shortest runs of lines that reach ``LONG`` words, from each
line on and up to each line, are chunks too (``runs``). Each line of a passage of that many words lies in such a run
inside the passage, so that none of it stays, whatever its number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, named_back, set_aside, settle

FAMILIES = 4
LONG = 50
MOST = 5
_BASE, _PRIME = 1_000_003, 2_147_483_647
#: Numbers of documents that may be broadcast (some 40 bytes each); more are shuffled.
BROADCAST_ROWS = 2_000_000
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


def _lines(column: str = "text") -> Column:
    return F.split(F.col(column), "\n", -1)


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with lines, x (64 bits a line) and h (32 bits of its MD5, below the prime)."""
    rows = rows.withColumn("lines", _lines())
    h = F.transform("lines", lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % _PRIME)
    return rows.withColumns({"x": F.transform("lines", lambda line: F.xxhash64(line)), "h": h})


def _word_lines() -> Column:
    """The line (from 0) of each word of ``lines``, in order."""
    return F.flatten(F.transform("lines", lambda line, i: F.array_repeat(i, F.regexp_count(line, F.lit(WORD)))))


def _runs(n: int) -> Column:
    """Runs of ``n`` words that start with a line's first word or end with its last one, as spans of ``owner``'s lines."""
    line = lambda k: F.get("owner", k)
    last = F.size("owner") - 1
    at = F.when(last >= n - 1, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(at, lambda k: ~line(k - 1).eqNullSafe(line(k)))  # of each line with words

    def spans(firsts: Column) -> Column:
        down = F.transform(F.filter(firsts, lambda k: k + (n - 1) <= last), lambda k: _span(line(k), line(k + (n - 1))))
        lasts = F.concat(F.transform(F.slice(firsts, F.lit(2), F.size(firsts)), lambda k: k - 1), F.array(last))
        return F.concat(down, F.transform(F.filter(lasts, lambda k: k >= n - 1), lambda k: _span(line(k - (n - 1)), line(k))))

    return F.flatten(F.transform(F.array(firsts), spans))


def _span(a: Column, b: Column) -> Column:
    return F.struct((a + 1).alias("first"), (b + 1).alias("last"))


def _spans(rows: DataFrame, families: int, long_words: int, runs: bool) -> DataFrame:
    """uid, first and last line (from 1) and a hash of every chunk that may go; what several families cut alike comes once."""
    rows = _hashed(rows)
    owner = ["owner"] if runs else []
    rows = rows.withColumn("owner", _word_lines()) if runs else rows
    long_lines = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _spaces(F.get("lines", i)) >= long_words - 1)
    rows = rows.select("uid", "x", "h", long_lines.alias("long"), *owner)
    rolling = F.transform("h", lambda h, i: ((F.lit(_BASE) + F.coalesce(F.get("h", i - 1), F.lit(0))) % _PRIME * _BASE + h) % _PRIME)
    rows = rows.select("uid", "x", "long", rolling.alias("r"), *owner)
    rows = rows.select("uid", "x", "long", F.transform("r", lambda r: r.bitwiseAND((1 << families) - 1).cast("int")).alias("bits"), *owner)

    def cut(i: Column) -> Column:
        """A chunk's end in each way: at the first line whose bit is set; one mask tells which ways are still open."""
        open_ways, ends = F.lit((1 << families) - 1), []
        for j in range(1, MOST - 1):
            here = F.coalesce(F.get("bits", i + j), F.lit(0))
            ends.append(F.when(open_ways.bitwiseAND(here) != 0, _span(i, i + j)))
            open_ways = open_ways.bitwiseAND(F.bitwise_not(here))
        ends.append(F.when(open_ways != 0, _span(i, F.least(i + MOST - 1, F.size("bits") - 1))))
        return F.array_compact(F.array(*ends))

    several = F.when(F.size("bits") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size("bits") - 2), cut)))
    every = F.flatten(F.array_compact(F.array(F.transform("long", lambda i: _span(i, i)), several, *([_runs(long_words)] if runs else []))))
    # As numbers, which are made distinct by a hash set.
    codes = F.array_distinct(F.transform(every, lambda s: s["first"].cast("long") * (1 << 32) + s["last"]))
    every = F.transform(codes, lambda c: _span(F.shiftright(c, 32).cast("int") - 1, c.bitwiseAND((1 << 32) - 1).cast("int") - 1))
    rows = rows.select("uid", "x", F.explode(every).alias("s"))
    return rows.select("uid", "s.first", "s.last", F.xxhash64(_part("x", F.col("s"))).alias("hash"))


def _spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" ")))


def _part(lines: str, span: Column) -> Column:
    return F.slice(lines, span["first"], span["last"] - span["first"] + 1)


def repeated_lines(rows: DataFrame, families: int = FAMILIES, long_words: int = LONG, runs: bool = True) -> DataFrame:
    """uid, first, last: the runs of lines of ``rows`` (uid, doc_id, text) that repeat an earlier chunk."""
    spans = materialize(_spans(rows.select("uid", "text"), families, long_words, runs), "line-chunks")
    # Eight bytes a chunk decide, added up in each task first, which chunks can be repeated at all.
    twice = spans.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    maybe = spans.join(twice, "hash", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # of one document
    maybe = materialize(maybe, "repeated-chunks")
    # Only texts that have such chunks are moved, as long as their numbers can be broadcast; these always are.
    needed = broadcast_if_small(maybe.select("uid"), maybe.count(), BROADCAST_ROWS)
    lines = _hashed(materialize(rows.join(needed, "uid", "left_semi").join(maybe.hint("merge"), "uid"), "line-candidates"))
    # Bytes are compared here, line by line: do lines of equal hashes have equal bytes? If not, chunks are compared by their text.
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    each = lines.select("x", "h", "lines", F.explode(inside).alias("i")).select(*[F.get(c, F.col("i") - 1).alias(c) for c in ("x", "h", "lines")])
    differ = each.groupBy("x", "h").agg(F.count_distinct("lines").alias("n")).where("n > 1")
    key = F.concat(_part("x", F.col("s")), _part("h", F.col("s"))) if differ.isEmpty() else _part("lines", F.col("s"))
    chunks = lines.select("uid", "doc_id", "lines", "x", "h", F.explode("spans").alias("s")).where(F.trim(F.array_join(_part("lines", F.col("s")), "")) != "")
    chunks = chunks.select("uid", "doc_id", "s.first", "s.last", key.alias("chunk"))
    place = F.struct(F.col("doc_id").isNull().alias("last_of_all"), "doc_id", "uid", "first")
    kept = chunks.groupBy("chunk").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = chunks.join(materialize(kept, "kept-chunks"), "chunk").where((F.col("kept.uid") != F.col("uid")) | (F.col("kept.first") != F.col("first")))
    return gone.select("uid", "first", "last")


def dedup_lines(docs: DataFrame, families: int = FAMILIES, long_words: int = LONG, runs: bool = True) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and n_lines, n_removed (lines before, and gone).

    With ``runs``, every passage of ``long_words`` words or more goes, whatever its number of lines; a word
    is a run of characters that aren't white space.

    Lines end at ``\\n``; a null text stays null with no lines, an empty one is one empty line. Chunks of
    white space alone are kept. Of repeated rows the first loses nothing and the others lose every passage
    that may go; null ids come after all others, equal ids in the order of the rows. Columns named
    n_lines or n_removed are replaced, all others stay; n_chars, where there is one, is counted anew. Very long
    texts are taken whole; an empty table gives no rows.
    """
    kept, names = set_aside(docs, "doc_id", "text", replaced=("n_lines", "n_removed"))
    base = materialize(kept.withColumn("uid", F.monotonically_increasing_id()), "line-dedup")

    def numbers_gone() -> DataFrame:
        gone = repeated_lines(base.select("uid", "doc_id", F.col("text").cast("string").alias("text")).where("text is not null"), families, long_words, runs)
        by_doc = gone.distinct().select("uid", F.explode(F.sequence("first", "last")).alias("line")).distinct()
        return by_doc.groupBy("uid").agg(F.collect_set("line").alias("gone"))  # as many as the document has lines, at most

    out = base.join(settle(docs.sparkSession, "lines-gone", numbers_gone), "uid", "left")
    numbers = F.sequence(F.lit(1), F.size(_lines()))
    left = F.transform(F.array_except(numbers, "gone"), lambda i: F.get(F.col("lines"), i - 1))  # a hash set
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = out.withColumn("lines", _lines())
    out = out.withColumns({"cut": text, "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")})
    instead = {own: F.length("cut").cast(docs.schema[c].dataType) for own, c in names.items() if c.lower() == "n_chars"}
    return out.select(*named_back(names, text=F.col("cut"), **instead), "n_lines", "n_removed")


ORACLE = r"""
WITH doc AS (SELECT row_number() OVER (ORDER BY doc_id) AS u, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT u, i, l[i] AS line FROM (SELECT u, l, unnest(range(1, len(l) + 1)) AS i FROM doc WHERE text IS NOT NULL)),
h AS (SELECT u, i, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % 2147483647 AS h, length(line) - length(replace(line, ' ', '')) >= 49 AS long FROM line),
p AS (SELECT *, ((1000003 + coalesce(lag(h) OVER w, 0)) % 2147483647 * 1000003 + h) % 2147483647 AS r, max(i) OVER (PARTITION BY u) AS n FROM h WINDOW w AS (PARTITION BY u ORDER BY i)),
q AS (SELECT *, lead(r) OVER w AS r1, lead(r, 2) OVER w AS r2, lead(r, 3) OVER w AS r3 FROM p WINDOW w AS (PARTITION BY u ORDER BY i)),
word AS (SELECT u, i, unnest(range(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))) AS j FROM line),
run AS (SELECT u, i, lag(i) OVER w AS before, lead(i, 49) OVER w AS last, lead(i, 50) OVER w AS after FROM word WINDOW w AS (PARTITION BY u ORDER BY i, j)),
x AS (SELECT u, i AS first, CASE WHEN (r1 >> f) & 1 = 1 THEN i + 1 WHEN (r2 >> f) & 1 = 1 THEN i + 2 WHEN (r3 >> f) & 1 = 1 THEN i + 3 ELSE least(i + 4, n) END AS last
  FROM q, (SELECT unnest(range(0, 4))::INTEGER AS f) WHERE i < n UNION SELECT u, i, i FROM q WHERE long
  UNION SELECT u, i, last FROM run WHERE last IS NOT NULL AND (before IS DISTINCT FROM i OR after IS DISTINCT FROM last)),
s AS (SELECT u, first, last, array_to_string(l[first:last], chr(10)) AS chunk FROM x JOIN doc USING (u)),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY u, first) AS rn FROM s WHERE trim(replace(chunk, chr(10), '')) <> ''),
gone AS (SELECT DISTINCT u, unnest(range(first, last + 1)) AS i FROM r WHERE rn > 1),
cut AS (SELECT line.u, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '') AS cut FROM line LEFT JOIN gone ON gone.u = line.u AND gone.i = line.i GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(cut) AS n_chars_left, md5(cut) AS text_md5 FROM doc LEFT JOIN cut USING (u)
"""
