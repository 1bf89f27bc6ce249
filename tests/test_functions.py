from __future__ import annotations

import hashlib
import hmac
import random
import json
import re
import unicodedata
from datetime import datetime, timedelta
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from linkspan.functions import jsonx, numbers, text


def one(spark, *columns, **values):
    """The columns' values over one row of strings."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize(
    ("raw", "region", "want"),
    [
        *[(x, "IT", "+393475550199") for x in ("+39 347 5550199", "0039.347.555.0199", "347-555-0199", "3475550199", "+39(347)5550199", "tel:+393475550199", " TEL: 347 555 01 99", "347\u200b5550199")],
        ("0161 496 0777", "GB", "+441614960777"), ("(415) 555-0136", "US", "+14155550136"), ("01 99 00 12 34", "FR", "+33199001234"), ("+33 1 99 00 12 34", "GB", "+33199001234"),
        ("", "IT", None), (" \t", "IT", None), ("no phone here", "IT", None), ("347 5550199", None, None), ("347 5550199", "XX", None), (None, "IT", None), ("+39 12", "IT", None),
    ],
)
def test_phone(spark, raw, region, want):
    assert one(spark, text.phone_e164(F.col("p"), F.col("r")), p=raw, r=region) == (want,)


def plain_url(url):
    """By Python's own parser: what a comparable address is."""
    p = urlparse(url.strip())
    path = p.path.rstrip("/") if len(p.path) > 1 else p.path
    query = urlencode(sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in text.TRACKING))
    return urlunparse((p.scheme.lower(), p.netloc.lower(), path, "", query, ""))


def test_url(spark):
    urls = ["https://WWW.Shop.example/Items//", "HTTP://u:P@Host.example:8080/a;x=1/b;y=2/", "https://h.example", "https://h.example/", "https://h.example/?", "https://h.example?z&y=&x=1&x=0&&a+b=c%20d*~/%C3%A9#part", " https://h.example/q \n"]
    urls += [f"https://h.example/p?{t}=1&keep=2&{t.upper()}=3" for t in text.TRACKING] + ["https://h.example/p?mc_cid=1&utm_id=2", "//h.example/x/", "rel/path/?b=1&a=2", "", "/", "https://h.example/a?u=%7e%2a%28é"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.normal_url(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in got} == {u: plain_url(u) for u in urls}


def test_origin(spark):
    got = one(spark, *[text.origin(F.lit(u)) for u in ("HTTPS://A.com/x", "http://a.com:8080/", "/relative")])
    assert got == ("https:a.com:443", "http:a.com:8080", None)


def test_masks_and_hashes(spark):
    got = one(spark, text.mask_phone(F.lit("+393331234567")), text.mask_phone(F.lit("12345")), text.mask_tail(F.lit("+39 333 1234567")), text.mask_tail(F.lit("none")), text.hmac_sha256(F.lit("x"), b"key"))
    assert got == ("+39********67", "*****", "***4567", "***", hmac.new(b"key", b"x", hashlib.sha256).hexdigest())


def test_full_phone(spark):
    assert one(spark, *[text.full_phone(F.lit(x)) for x in ("333", "12", "", "+39 333 1234567")]) == (False, False, False, True)


def test_errors_round_trip(spark):
    code, message = text.decode_error(text.encode_error(F.lit("http_error"), F.lit("gone")))
    bare_code, bare = text.decode_error(F.lit("no prefix"))
    assert one(spark, code, message, bare_code, bare) == ("http_error", "gone", None, "no prefix")


def test_text(spark):
    got = one(spark, text.fold_key(F.lit("  Età Média!")), text.fold_key(F.lit("Age")), text.humanise(F.lit("source_Created"), F.lit("1234567890")), text.filled(F.lit(""), "x"), text.normal_text(F.lit("  A \n B ")))
    assert got == ("eta_media", "eta", "Source created (12345678)", "x", "a b")


# The patterns that links and phones must match.
LINK = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
PHONE = re.compile(r"(?<!\w)(?:\+?\d[\s().-]*){8,15}(?!\w)")


def test_redaction(spark):
    r = random.Random(11)
    bits = ["https://a.b/c?d=1", "WWW.x.y", "HTTP://", "+39 333 123 4567", "0039", "12345678", "1234567", "x12345678", "12345678é", "1 2 3 4 5 6 7 8", "(02)-555.12.34.56", "+", "-", "_", "é", " ", " ", "\n", "\u00a0", "\u200b", "٣٤٥٦٧٨٩٠", "me@mail.example", "9" * 40]
    texts = ["".join(r.choice(bits) for _ in range(r.choice([1, 3, 8]))) for _ in range(800)] + ["1" + " " * 5000 + "2345678", "a" * 40_000, "1 " * 20_000]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.redact(F.col("t")).alias("r")).collect()
    assert {x.i: x.r for x in got} == {i: PHONE.sub("[PHONE REDACTED]", LINK.sub("[URL REDACTED]", t)) for i, t in enumerate(texts)}


def test_mime(spark):
    heads = {
        "FFD8FFE0": "image/jpeg", "474946383961": "image/gif", "0000001C6674797071742020": "video/quicktime", "00000018667479706D703432": "video/mp4", "": "application/octet-stream",
        "524946460000000057454250": "image/webp", "000000000000000057454250": "application/octet-stream", "000000000000000071742020": "application/octet-stream", "0000001866747970": "application/octet-stream",
    }
    assert one(spark, *[text.mime_type(F.unhex(F.lit(h))) for h in heads]) == tuple(heads.values())


def test_completeness(spark):
    fields = {'{"a": "x", "b": " ", "c": null, "d": [], "e": [""], "f": 0, "g": {}, "h": false}': 5, "{}": 0, "[1]": 0, "nothing": 0, '{"a": "[]"}': 1}
    assert one(spark, *[jsonx.informative_fields(F.lit(x)) for x in fields]) == tuple(fields.values())
    assert one(spark, text.filled_fields(F.lit("t"), F.lit(" \t\n"), F.lit(None).cast("string"), F.lit("")), text.filled_fields()) == (1, 0)


def test_answers_of_exactly_a_form(spark):
    good = {"summary": "s", "advertisement_information": [{"source_ref": "a", "title": None, "facts": ["x"]}], "forum_information": [{"snippet": "y"}], "unverified_claims": [], "sources": ["q"]}
    ad = good["advertisement_information"][0]
    also = [good | {"advertisement_information": [], "forum_information": []}, good | {"advertisement_information": [ad | {"title": "t"}, ad]}]
    bad = [
        good | {"more": 1}, good | {"summary": None}, good | {"summary": 1}, {k: v for k, v in good.items() if k != "sources"}, good | {"sources": [1]}, good | {"sources": [None]}, good | {"sources": {}},
        good | {"advertisement_information": [ad | {"more": 1}]}, good | {"advertisement_information": [ad, {"source_ref": "a", "facts": []}]}, good | {"advertisement_information": [ad | {"facts": "x"}]}, good | {"forum_information": [{}]}, [good],
    ]
    texts = [*map(json.dumps, [good, *also, *bad]), "{", None]
    assert one(spark, *[jsonx.follows(F.lit(x), jsonx.SUMMARY) for x in texts]) == (*[True] * 3, *[False] * (len(bad) + 2))


def test_paths_by_python(spark):
    doc = {"a": {"b": [1, {"c": "x", "q": None}, [2, 3]], "d": None}, "t": "y", "0": {"": "z"}}
    paths = ["t", "a.d", "a", "a.b", "a.b.0", "a.b.1.c", "a.b.1.q", "a.b.2.1", "0", "0.", "new", "a.new", "a.b.3", "a.b.-1", "a.b.x", "t.x", "q.r", "a.b.0.z", "a.d.x", "0.0.0"]

    def put(path):
        out = json.loads(json.dumps(doc))
        at, (*way, last) = out, path.split(".")
        try:
            for p in way:
                at = at[int(p)] if isinstance(at, list) else at[p]
            if isinstance(at, list):
                if not 0 <= int(last) < len(at):
                    return None
                at[int(last)] = {"n": [1]}
            elif isinstance(at, dict):
                at[last] = {"n": [1]}
            else:
                return None
        except (KeyError, ValueError, IndexError, TypeError):
            return None
        return out

    df = spark.createDataFrame([(json.dumps(doc), p) for p in paths] + [(None, "t"), (json.dumps(doc), None), ("{", "t")], "x string, p string")
    edited = jsonx.set_path(F.col("x"), F.col("p"), F.lit('{"n": [1]}'))
    rows = df.select("p", edited.alias("s"), jsonx.get_path(edited, F.col("p")).alias("g")).collect()
    for r, p in zip(rows, paths):
        assert (r.s and json.loads(r.s)) == put(p), p
        assert r.g == (None if r.s is None else '{"n":[1]}'), p
    assert [r.s for r in rows[len(paths) :]] == [None] * 3


def test_folding_of_every_character(spark):
    """As Python decomposes them; in texts of many characters, so that each stands beside others."""

    def fold(v):
        bare = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
        key = re.sub(r"[^a-z0-9]+", "_", bare.lower()).strip("_")
        return "eta" if key == "age" else key

    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["ﬁne", "Ａｂ", "½ x", "①", "№ 5", "", "ÂGE"] + ["x".join(every[i : i + 500]) for i in range(0, len(every), 500)]
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fold_key(F.col("t")).alias("k")).collect()}
    assert [got[t] for t in texts[:7]] == ["fine", "ab", "1_2_x", "1", "no_5", "", "eta"]
    assert all(got[t] == fold(t) for t in texts)


def test_white_space_of_any_script(spark):
    space = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    assert one(spark, text.normal_text(F.lit(f"{space}A{space}b　c\xa0")), text.normal_text(F.lit(None))) == ("a b c", "")


def test_known_answer_of_gcm(spark):
    """An answer published for AES-256-GCM: zero key, zero nonce, sixteen zero bytes."""
    sealed = F.aes_encrypt(F.lit(bytearray(16)), F.lit(bytearray(32)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray(12)))
    assert one(spark, F.hex(sealed))[0] == "00" * 12 + "CEA7403D4D606B6E074EC5D3BAF39D18" + "D0D1C8A799996BF0265B98B5D48AB919"


def test_numbers(spark):
    pct = lambda a, b: numbers.percentage(F.lit(a), F.lit(b))
    delta = lambda a, b: numbers.percentage_delta(F.lit(a), F.lit(b))
    assert one(spark, pct(1, 3), pct(1, 0), delta(5, 0), delta(0, 0), delta(3, 2)) == (33.3, 0.0, 100.0, 0.0, 50.0)
    status = lambda x: numbers.confidence_status(F.lit(x).cast("double"))
    assert one(spark, status(0.85), status(0.8), status(None)) == ("verified", "unverified", "unverified")
    assert one(spark, *[numbers.step(numbers.COOLDOWN_MINUTES, F.lit(n)) for n in (0, 1, 4, 9)]) == (None, 5, 60, 60)
    assert one(spark, *[numbers.duration_text(F.lit(n).cast("long")) for n in (None, 59, 3600, 7325)]) == ("-", "0m 59s", "1h 0m", "2h 2m")


def test_ranges():
    now = datetime(2026, 1, 10)
    assert numbers.resolve_range(None, None, now) == numbers.TimeRange(now - timedelta(days=1), now)
    assert numbers.resolve_range(datetime(2026, 1, 1), datetime(2026, 1, 2), now).before.start == datetime(2025, 12, 31)
    for a, b in ((None, now), (now, None), (now, datetime(2026, 1, 1)), (datetime(2025, 1, 1), now), (now, now + timedelta(days=1))):
        with pytest.raises(ValueError):
            numbers.resolve_range(a, b, now)


def test_skipped_hours(spark):
    at = lambda x: numbers.local_to_utc(F.lit(x).cast("timestamp"), "Europe/Rome")
    assert one(spark, at("2026-03-29 02:30:00"), at("2026-03-29 03:30:00")) == (None, datetime(2026, 3, 29, 1, 30))


def test_json(spark):
    a, b = (jsonx.json_hash(F.lit(x)) for x in ('{"b": [1, 2], "a": {"y": "è", "x": null}}', '{"a":{"x":null,"y":"è"},"b":[1,2]}'))
    got = one(spark, a, b, jsonx.canonical_json(F.lit("{")))
    assert got[0] == got[1] == hashlib.sha256('{"a":{"x":null,"y":"è"},"b":[1,2]}'.encode()).hexdigest() and got[2] is None
    values = {'"x"': True, '" "': False, "[]": False, "[0]": True, "{}": True, "3": False, "": False}
    assert one(spark, *[jsonx.has_value(F.lit(v)) for v in values]) == tuple(values.values())
    same = one(spark, jsonx.set_hash(F.array(F.lit("a"), F.lit("b"))), jsonx.set_hash(F.array(F.lit("b"), F.lit("a"), F.lit("b"))))
    assert same[0] == same[1]


def test_resolve(spark):
    from urllib.parse import urljoin

    pages = ["https://a.com/x/y?q=1#f", "https://a.com", "http://a.com:80/d/"]
    hrefs = ["", "z", "/z?k", "//b.org/c", "?p=2", "#top", "mailto:a@b", "https://c.net/", "../z", "../../../z?a=../b", "./", "..", "a/./b/../c", "/x/../../y/", ".hidden/..a"]
    got = one(spark, *[text.resolve_url(F.lit(p), F.lit(h)) for p in pages for h in hrefs])
    assert got == tuple(urljoin(p, h) if h else p for p in pages for h in hrefs)


#: Numbers made up for this test: region, as written there, E.164.
NUMBERS = """IT|333 123 4567|+393331234567
IT|06 1234567|+39061234567
GB|020 7946 0958|+442079460958
US|1 (202) 555-0143|+12025550143
CA|613 555 0199|+16135550199
FR|01 99 00 12 34|+33199001234
DE|030 901820|+4930901820
ES|612 345 678|+34612345678
AT|0664 1234567|+436641234567
BE|0470 12 34 56|+32470123456
CH|079 123 45 67|+41791234567
CZ|601 123 456|+420601123456
DK|32 12 34 56|+4532123456
FI|041 2345678|+358412345678
GR|691 234 5678|+306912345678
HU|06 20 123 4567|+36201234567
IE|085 012 3456|+353850123456
NL|06 12345678|+31612345678
NO|406 12 345|+4740612345
PL|512 345 678|+48512345678
PT|912 345 678|+351912345678
RO|0712 034 567|+40712034567
SE|070-123 45 67|+46701234567
SI|031 234 567|+38631234567
SK|0912 123 456|+421912123456
TR|0501 234 56 78|+905012345678
UA|050 123 4567|+380501234567
AU|0412 345 678|+61412345678
BR|(11) 96123-4567|+5511961234567
IN|081234 56789|+918123456789
JP|090-1234-5678|+819012345678
SG|8123 4567|+6581234567
ZA|071 123 4567|+27711234567"""


def test_numbering_plan(spark):
    cases = [line.split("|") for line in NUMBERS.splitlines()]
    rows = [(raw, region, want) for region, raw, want in cases] + [(want, "US", want) for _, _, want in cases] + [(want.replace("+", "00"), None, want) for _, _, want in cases]
    rows += [("+44 (0)20 7946 0958", "IT", "+442079460958"), ("+999 123456", "IT", None), ("+393331", "IT", None), ("12", "IT", None), ("512 345 678", None, None), ("512 345 678", "XX", None), ("+383 44 123 456", "IT", None), ("", "IT", None), (None, "IT", None), ("+1 202 555 01433", "US", None), ("call me", "IT", None)]
    df = spark.createDataFrame(rows, "raw string, region string, want string")
    assert [(r.raw, r.got) for r in df.select("raw", "want", text.phone_e164(F.col("raw"), F.col("region")).alias("got")).collect()] == [(raw, want) for raw, _, want in rows]
    assert len({x[0] for x in text.PHONE_PLAN}) >= 60
    own = (("XX", "999", "9", 5, 6),)
    assert one(spark, text.phone_e164(F.lit("9 12345"), F.lit("XX"), own), text.phone_e164(F.lit("+39 333 1234567"), F.lit("XX"), own)) == ("+99912345", None)
