"""Licence scan by ordered signature rules with a keyword prefilter; a better detection suppresses what lies inside it.

A text is brought to its words, A-Z lower-cased, with one space between. Of the rules (``license_rules``), only those whose
keyword is among the words are searched for. Detections overlap: "apache license version 2" holds "apache license", and a
notice holds the name. Each goes if it lies inside a detection of a higher level, inside a longer one of its own level, or
has the same place as one of an earlier rule; so what is left are the outermost readings. The places that the contract
fixes (starred rules) are found the same way, but neither suppressed nor suppressing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import passing_schema
from .license_rules import RULES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: How sure a detection of each level is.
SURE = (0.5, 0.7, 0.85, 0.9, 0.99, 1.0)


class Rule(NamedTuple):
    label: str
    level: int  # -1: a fixed place
    keyword: bytes
    pattern: re.Pattern
    order: int


class Found(NamedTuple):
    start: int  # bytes of the normal text
    end: int
    rule: Rule


def read_rules(text: str = RULES) -> list[Rule]:
    """The rules of a listing, in its order."""
    rules, label = [], ""
    for line in text.splitlines():
        if line and not line.startswith(" "):
            label = line
        elif line:
            level, keyword, pattern = line.split(maxsplit=2)
            rules.append(Rule(label, -1 if level == "*" else int(level), keyword.rstrip(":").encode(), re.compile(b"(?<= )(?:%s)(?= )" % pattern.encode()), len(rules)))
    return rules


def by_keyword(rules: list[Rule]) -> dict[bytes, list[Rule]]:
    out: dict[bytes, list[Rule]] = {}
    for r in rules:
        out.setdefault(r.keyword, []).append(r)
    return out


def detections(words: list[bytes], keyed: dict[bytes, list[Rule]]) -> tuple[bytes, list[Found]]:
    """The normal text, and what the rules find in it whose keyword is there."""
    present = keyed.keys() & set(words)
    if not present:
        return b"", []
    text = b" %s " % b" ".join(words)
    return text, [Found(m.start(), m.end(), r) for k in present for r in keyed[k] for m in r.pattern.finditer(text)]


def outermost(found: list[Found]) -> list[Found]:
    """Detections that lie in none of a higher level, nor in another one of their level; fixed places take no part.

    In the order of starts, longer ones first, it is enough to know how far each level has reached.
    """
    reach, out = [-1] * len(SURE), []
    for f in sorted((f for f in found if f.rule.level >= 0), key=lambda f: (f.start, -f.end, -f.rule.level, f.rule.order)):
        if max(reach[f.rule.level :]) < f.end:
            out.append(f)
        reach[f.rule.level] = max(reach[f.rule.level], f.end)
    return out


SPAN = StructType([StructField("label", StringType()), StructField("level", IntegerType()), StructField("first_word", LongType()), StructField("n_words", LongType())])
ADDED = (
    ("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()), ("base_labels", StringType()),
    ("labels", StringType()), ("score", DoubleType()), ("spans", ArrayType(SPAN)),
)


def scan(raw: bytes, keyed: dict[bytes, list[Rule]]) -> tuple:
    """The values of ``ADDED`` for one text."""
    words = WORD.findall(raw.lower())  # of bytes: A-Z alone
    text, found = detections(words, keyed)
    if not found:
        return len(words), 0, None, None, "", "", 0.0, []
    fixed, kept = sorted(f for f in found if f.rule.level < 0), outermost(found)
    labels = {f.rule.label for f in (*fixed, *kept)}
    doubt = 1.0
    for label in sorted(labels):
        doubt *= 1 - max((SURE[f.rule.level] for f in kept if f.rule.label == label), default=SURE[1])
    place, at, spans = 0, 0, {}
    for f in sorted({(f.start, f.end) for f in (*fixed, *kept)}):  # words before each start, counted on from the last one
        place, at = place + text.count(b" ", at, f[0]), f[0]
        spans[f] = place - 1
    starts = [spans[f.start, f.end] for f in fixed]
    rows = [{"label": f.rule.label, "level": f.rule.level, "first_word": spans[f.start, f.end], "n_words": text.count(b" ", f.start, f.end) + 1} for f in kept]
    base = ",".join(sorted({f.rule.label for f in fixed}))
    return len(words), len(fixed), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), 1 - doubt, rows


def _scan(rules: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = by_keyword(read_rules(rules))
        for b in batches:
            made = [scan(t.as_py() or b"", keyed) for t in b.column("text").cast(pa.binary())]
            columns = list(zip(*made)) or [()] * len(ADDED)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("level", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*b.schema.names, *(n for n, _ in ADDED)])

    return run


def scan_licenses(docs: DataFrame, rules: str = RULES) -> DataFrame:
    """``docs`` with n_words, n_base (fixed places), first_word and last_word (their smallest and largest start), base_labels,
    labels, score, and spans (label, level, first_word, n_words of each detection left).

    The score is 1 less the product of all labels' doubts; a label's doubt is that of its highest level. A null or an
    empty text has no words, no labels and a score of 0; very long texts are scanned whole, in time that grows with
    their length; equal places go to the earlier rule; repeated rows and null ids each keep their row; columns of the added
    names are replaced, all others stay; an empty table gives no rows. It needs no shuffle.
    """
    docs, schema = passing_schema(docs.withColumn("text", F.col("text").cast("string")), *ADDED)
    return docs.mapInArrow(_scan(rules), schema)
