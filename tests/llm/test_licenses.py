from __future__ import annotations

import random
import re
import re._parser as sre

import pytest

from linkspan.llm.license_rules import RULES
from linkspan.llm.licenses import Found, by_keyword, outermost, read_rules, scan, scan_licenses

KEYED = by_keyword(read_rules())
#: Fixed values of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def samples(parsed, pick):
    """A string that a pattern matches; ``pick`` chooses among branches and numbers of repeats."""
    out = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "IN":
            kind, what = value[0]
            out.append({"LITERAL": lambda: chr(what), "RANGE": lambda: chr(what[0]), "CATEGORY": lambda: "x"}[str(kind)]())
        elif name == "BRANCH":
            out.append(samples(pick(value[1]), pick))
        elif name == "SUBPATTERN":
            out.append(samples(value[-1], pick))
        elif name == "MAX_REPEAT":
            low, high, what = value
            out += [samples(what, pick) for _ in range(pick([low, min(high, low + 2)]))]
        else:
            raise AssertionError(name)
    return "".join(out)


def test_there_are_hundreds_of_rules_and_each_finds_its_own_forms():
    rules = read_rules()
    assert len(rules) > 250
    r = random.Random(3)
    lines = [x.split(maxsplit=2)[2] for x in RULES.splitlines() if x.startswith(" ")]
    for rule, line in zip(rules, lines, strict=True):
        for _ in range(20):
            form = samples(sre.parse(line), r.choice)
            assert rule.keyword.decode() in form.split(), (rule.label, form)  # else the prefilter would lose it
            assert rule.pattern.search(f" {form} ".encode()), (rule.label, form)
            assert rule.label in scan(form.encode(), KEYED)[5].split(",") or any(x.level >= rule.level for x in rules if x.pattern.search(f" {form} ".encode()) and x is not rule), (rule.label, form)


@pytest.mark.parametrize(
    ("text", "labels", "base"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2", "apache-2"),
        ("Released under the MIT License.", "mit", "mit"),
        ("GNU General Public License, version 3", "gpl-3", ""),
        ("the GNU GPL", "gpl", ""),
        ("the GNU Lesser General Public License v2.1", "lgpl-2.1", ""),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa", "cc-by-nc"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3", ""),
        ("see https://www.mozilla.org/MPL/2.0/ and the Mozilla Public License", "mpl,mpl-2", ""),
        ("Alle Rechte vorbehalten.", "all-rights-reserved", ""),
        ("under  the\nMIT-license; CC/BY/NC", "cc-by-nc,mit", "cc-by-nc,mit"),
        ("mit der Lizenz, permit licenses, the general public, version 2.0", "", ""),
        ("underthe mit license agreement", "mit", ""),
        ("UNDER THE MÍT LICENSE", "", ""),
    ],
)
def test_texts(text, labels, base):
    found = scan(text.encode(), KEYED)
    assert (found[5], found[4]) == (labels, base)
    assert (found[6] > 0) == bool(labels)


def slow_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_by_brute_force(spark):
    r = random.Random(5)
    words = "under the mit license apache version 2 cc by nc gpl é MIT License 2.0".split()
    texts = ["".join(r.choice(words) + r.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(r.choice([0, 3, 40, 400]))) for _ in range(300)] + [" ".join(PHRASES) * 3]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (7, "Under the MIT license"), (7, "Under the MIT license"), (900, "cc by nc " * 60_000)], "doc_id long, text string")
    rows = scan_licenses(docs).collect()
    assert len(rows) == len(texts) + 4
    for x in rows:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == slow_base(x.text)
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_suppression_by_brute_force():
    r, rules = random.Random(8), [x for x in read_rules() if x.level >= 0]
    for _ in range(300):
        found = [Found(a, a + r.randint(1, 12), r.choice(rules)) for a in (r.randrange(20) for _ in range(r.randint(0, 12)))]
        rank = lambda f: (f.end - f.start, f.rule.level, -f.rule.order)
        inside = lambda f, g: g.start <= f.start and f.end <= g.end and g.rule.level >= f.rule.level and (rank(g) > rank(f))
        want = {f for f in found if not any(inside(f, g) for g in found)}
        assert set(outermost(found)) == want


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mit license", 5, "a", True), (None, "", None, None, None)], "doc_id int, text string, SCORE int, labels string, extra boolean")
    out = scan_licenses(docs)
    assert [c for c in out.columns if c.lower() == "score"] == ["score"] and "extra" in out.columns
    assert {(r.doc_id, r.labels, r.n_words, r.extra) for r in out.collect()} == {(1, "mit", 2, True), (None, "", 0, None)}
    assert scan_licenses(docs.where("false")).count() == 0
    span = out.where("doc_id = 1").first().spans[0]
    assert (span.label, span.first_word, span.n_words) == ("mit", 0, 2)


def test_no_shuffle(spark):
    plan = scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
