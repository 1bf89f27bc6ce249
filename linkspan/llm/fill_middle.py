"""Fill-in-middle transformation of texts, cut at units by a sparse index of checkpoints.

A unit is a word with the white space before it, or the white space that ends a text. While units are counted,
every ``STEP`` of them leave a checkpoint: units, bytes and code points so far. A cut then takes a binary search
among the checkpoints and a scan of fewer than ``STEP`` units behind the one found, so a text is read once to count and
never cut into a list of its units.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .common import passing_schema

#: Units between two checkpoints.
STEP = 64
#: Marks of the parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_WORD = rb"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
_ONE, _MANY, _SPACE = re.compile(_WORD), re.compile(rb"(?:%s){%d}" % (_WORD, STEP)), re.compile(rb"[\x20\x09-\x0D]+\Z")


class Checkpoints(NamedTuple):
    """Where every ``STEP``-th unit of a text ends, from 0 on: number of units, bytes and code points before it; and all units."""

    units: list[int]
    bytes: list[int]
    points: list[int]
    n: int


def code_points(raw: bytes) -> int:
    """Code points of UTF-8 bytes; of other bytes those that begin one."""
    try:
        return len(raw.decode())
    except UnicodeDecodeError:
        return sum(b & 0xC0 != 0x80 for b in raw)


def checkpoints(raw: bytes) -> Checkpoints:
    """Count the units of ``raw``."""
    units, ends, points, at = [0], [0], [0], 0
    while m := _MANY.match(raw, at):
        points.append(points[-1] + code_points(raw[at : m.end()]))
        at = m.end()
        units.append(units[-1] + STEP)
        ends.append(at)
    n = units[-1]
    while m := _ONE.match(raw, at):
        n, at = n + 1, m.end()
    return Checkpoints(units, ends, points, n + bool(_SPACE.match(raw, at)))


def cut(raw: bytes, index: Checkpoints, unit: int) -> tuple[int, int]:
    """Bytes and code points before the end of the first ``unit`` units."""
    if unit >= index.n:
        return len(raw), index.points[-1] + code_points(raw[index.bytes[-1] :])
    near = bisect_right(index.units, unit) - 1
    start = at = index.bytes[near]
    for _ in range(unit - index.units[near]):
        at = _ONE.match(raw, at).end()
    return at, index.points[near] + code_points(raw[start:at])


def draws(doc_id: int | None, seed: int = 42) -> list[int]:
    """Four numbers of 32 bits from a document's id."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


def transform(raw: bytes, doc_id: int | None, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (none if plain), and the text in its form."""
    index = checkpoints(raw)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= rate or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, raw
    first, last = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, before), (b, upto) = cut(raw, index, first), cut(raw, index, last)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < spm_rate:
        return index.n, "spm", before, upto - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return index.n, "psm", before, upto - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


ADDED = (("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType()))


def _apply(seed: int, rate: int, spm_rate: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("text").cast(pa.binary())
            made = [transform(t.as_py() or b"", d, seed, rate, spm_rate) for t, d in zip(raw, b.column("doc_id").to_pylist())]
            columns = list(zip(*made)) or [()] * 5
            # What was valid stays so: cuts lie between code points.
            added = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())]
            output = pa.array(columns[4], pa.binary())
            output = pa.Array.from_buffers(pa.string(), len(output), output.buffers())
            yield pa.RecordBatch.from_arrays([*b.columns, *added, output], [*b.schema.names, *(n for n, _ in ADDED)])

    return apply


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    ``rate`` of 100 documents are cut, ``spm_rate`` of 100 of these put the suffix first; the choice and both cuts come from
    ``seed`` and doc_id. A null or empty text is plain and empty, and so is one that has a mark of its own plain. A null
    id draws like an empty one; repeated rows, and rows of one id, fare alike where their texts do; two equal cuts give an
    empty middle. Texts are taken whole, the longest one as a row of its own size. Columns of the added names are replaced,
    all others stay; an empty table gives no rows. It needs no shuffle.
    """
    docs, schema = passing_schema(docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}), *ADDED)
    return docs.mapInArrow(_apply(seed, rate, spm_rate), schema)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of. Texts with marks are plain, so the marks of the others are their first ones."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
n AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
