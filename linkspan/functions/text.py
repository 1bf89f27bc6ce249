"""Text, URL, phone, hash and masking expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that say where a visit came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "ref", "referrer")
#: White space of any script, and what words are made of, as classes of a pattern.
_SPACE, _WORD = r"\t-\r\x1c-\x20\x85\p{Z}", r"\p{L}\p{N}_"
#: A link, and a phone of 8 to 15 digits that no word goes on from.
LINK = rf"(?iu)(?:https?://|www\.)[^{_SPACE}]+"
PHONE = rf"(?<![{_WORD}])(?:\+?\p{{Nd}}[{_SPACE}().-]*){{8,15}}(?![{_WORD}])"
#: Regions, their calling code, the trunk prefix dropped from national numbers (- for none), least and most digits after the code.
#: Any other plan, or a whole one, is a parameter of ``phone_e164``.
PHONE_PLAN = tuple(
    (region, code, trunk.strip("-"), int(least), int(most))
    for region, code, trunk, least, most in (
        line.split()
        for line in """
        US 1 1 10 10
        CA 1 1 10 10
        RU 7 8 10 10
        KZ 7 8 10 10
        EG 20 0 8 10
        ZA 27 0 9 9
        GR 30 - 10 12
        NL 31 0 9 11
        BE 32 0 8 9
        FR 33 0 9 9
        ES 34 - 9 9
        HU 36 06 8 9
        IT 39 - 6 11
        VA 39 - 6 11
        RO 40 0 9 9
        CH 41 0 9 9
        AT 43 0 4 13
        GB 44 0 9 10
        JE 44 0 9 10
        DK 45 - 8 8
        SE 46 0 6 10
        NO 47 - 5 8
        PL 48 - 9 9
        DE 49 0 6 13
        PE 51 0 8 9
        MX 52 - 10 10
        AR 54 0 10 11
        BR 55 0 8 11
        CL 56 - 9 9
        CO 57 0 8 11
        MY 60 0 8 10
        AU 61 0 9 9
        ID 62 0 8 12
        PH 63 0 8 10
        NZ 64 0 8 10
        SG 65 - 8 8
        TH 66 0 8 9
        JP 81 0 9 10
        KR 82 0 8 10
        VN 84 0 9 10
        CN 86 0 10 11
        TR 90 0 10 10
        IN 91 0 10 10
        MA 212 0 9 9
        TN 216 - 8 8
        NG 234 0 8 10
        KE 254 0 7 9
        PT 351 - 9 9
        LU 352 - 4 11
        IE 353 0 7 10
        IS 354 - 7 9
        AL 355 0 8 9
        MT 356 - 8 8
        CY 357 - 8 8
        FI 358 0 5 12
        BG 359 0 7 9
        LT 370 0 8 8
        LV 371 - 8 8
        EE 372 - 7 8
        UA 380 0 9 9
        RS 381 0 7 9
        HR 385 0 8 9
        SI 386 0 8 8
        CZ 420 - 9 9
        SK 421 0 9 9
        SM 378 - 6 10
        HK 852 - 8 8
        AE 971 0 8 9
        IL 972 0 8 9
        SA 966 0 9 9
        """.strip().splitlines()
    )
)


def _folding() -> tuple[str, str, str, list[str], str]:
    """How Unicode's compatibility forms without their marks read in ASCII, over all characters: those that become one
    letter or digit and what they become, those that become more and what they become, and all marks."""
    forms = ((c, "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()) for c in map(chr, range(0x80, 0x20000)) if not "\ud800" <= c <= "\udfff")
    found = [(c, plain) for c, plain in forms if any(x.isascii() and x.isalnum() for x in plain)]
    one, more = [x for x in found if len(x[1]) == 1], [x for x in found if len(x[1]) > 1]
    marks = "".join(c for c in map(chr, range(0x300, 0x20000)) if all(map(unicodedata.combining, unicodedata.normalize("NFKD", c))))
    return "".join(c for c, _ in one), "".join(x for _, x in one), "".join(c for c, _ in more), [x for _, x in more], marks


ONE, ONE_PLAIN, MORE, MORE_PLAIN, MARKS = _folding()
#: Magic numbers at the start in hexadecimal, and the type.
MAGIC = (
    ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("1A45DFA3", "video/webm"),
)


def filled(x: Column, fallback: str) -> Column:
    """``x``, or the fallback if it is null or empty (O2.11)."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))


def not_blank(x: Column) -> Column:
    return F.coalesce(x.rlike(rf"[^{_SPACE}]"), F.lit(False))


def filled_fields(*fields: Column) -> Column:
    """How many of the fields hold more than white space (O4.13)."""
    return sum((not_blank(x).cast("int") for x in fields), F.lit(0))


def normal_text(x: Column) -> Column:
    """White space of any script collapsed and trimmed, lower case; null is empty (O9.9)."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), rf"[{_SPACE}]+", " ")))


def normal_url(url: Column) -> Column:
    """An address to compare by (O9.7): scheme and host in lower case, no slashes at the path's end, no parameters of its
    last part, no tracking parameters, the others decoded, sorted and encoded again, no fragment.

    A parameter whose escapes are broken stays as it is but for its plus signs.
    """
    url = F.regexp_replace(url, rf"^[{_SPACE}]+|[{_SPACE}]+$", "")
    part = lambda i: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", i)
    path = F.regexp_replace(part(3), ";[^/]*$", "")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    plain = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    name = lambda p: F.substring_index(p, "=", 1)
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.struct(plain(name(p)).alias("k"), plain(F.substr(p, F.length(name(p)) + 2)).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    before = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise(F.lit(""))
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise(F.lit(""))
    return F.concat(scheme, before("//", F.lower(part(2))), path, before("?", query))


def origin(url: Column) -> Column:
    """Scheme, host and port with the scheme's default port written out (O9.8)."""
    part = lambda i: F.lower(F.regexp_extract(url, r"^([A-Za-z][^:/?#]*)://([^/?#:]*)(?::([0-9]+))?", i))
    port = F.when(part(3) != "", part(3)).when(part(1) == "https", "443").when(part(1) == "http", "80").otherwise("")
    return F.when(part(1) != "", F.concat_ws(":", part(1), part(2), port))


def defragment(url: Column) -> Column:
    """An address without its fragment (O9.8)."""
    return F.regexp_replace(url, "#.*$", "")


def resolve_url(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base`` (O9.8): absolute, by scheme, by host, query or fragment alone, or beside the page.

    Dot segments are folded; a blank href is the page itself.
    """
    href = F.trim(F.coalesce(href, F.lit("")))
    scheme = F.regexp_extract(base, r"^([^:/?#]+:)", 1)
    host = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    beside = F.when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))
    return (
        F.when(href == "", base).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("?"), F.concat(page, href)).when(href.startswith("#"), F.concat(defragment(base), href)).otherwise(without_dots(beside))
    )


def without_dots(url: Column) -> Column:
    """``.`` and ``..`` taken out of an address's path, none above its root."""
    part = lambda i: F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$", i)
    steps = F.split(F.regexp_replace(part(2), "^/", ""), "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        F.filter(steps, lambda x: x != "."), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    path = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when((part(1) != "") & part(2).rlike(r"(^|/)\.\.?(/|$)"), F.concat(part(1), path, part(3))).otherwise(url)


def phone_digits(raw: Column) -> Column:
    """A phone without a ``tel:`` prefix, white space, brackets, hyphens, dots and zero-width characters; 00 is +."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)^\s*tel:", ""), r"[\s().\-​-‍⁠﻿]", "")
    return F.regexp_replace(bare, "^00", "+")


def phone_e164(raw: Column, region: Column, plan: tuple[tuple[str, str, str, int, int], ...] = PHONE_PLAN) -> Column:
    """E.164 by a numbering plan; null if the number can't be one (O9.1).

    A number with ``+`` belongs to the longest calling code that it starts with, any other one to ``region``, without its trunk
    prefix. It is possible if it has as many digits as its code, or region, allows. A trunk prefix that was left in behind a code
    goes where the number is too long with it.
    """
    bare = phone_digits(raw)
    codes: dict[str, tuple[str, int, int]] = {}
    for _, code, trunk, least, most in plan:
        _, low, high = codes.get(code, ("", least, most))
        codes[code] = (trunk, min(low, least), max(high, most))
    row = lambda code, trunk, least, most: F.struct(F.lit(code).alias("code"), F.lit(trunk).alias("trunk"), F.lit(least).alias("least"), F.lit(most).alias("most"))
    of_code = F.create_map(*[x for code, rest in codes.items() for x in (F.lit(code), row(code, *rest))])
    of_region = F.create_map(*[x for name, *rest in plan for x in (F.lit(name), row(*rest))])
    digits = F.regexp_extract(bare, r"^\+([0-9]+)$", 1)
    longest = max(map(len, codes))
    found = F.coalesce(*[F.try_element_at(of_code, F.substring(digits, 1, n)) for n in range(longest, 0, -1)])
    rest = F.substr(digits, F.length(found["code"]) + 1)
    fits = lambda x, r: F.length(x).between(r["least"], r["most"])
    without = F.when((found["trunk"] != "") & rest.startswith(found["trunk"]), F.substr(rest, F.length(found["trunk"]) + 1))
    abroad = F.when(fits(rest, found), rest).when(fits(without, found), without)
    own = F.try_element_at(of_region, region)
    national = F.regexp_extract(bare, r"^([0-9]+)$", 1)
    short = F.when((own["trunk"] != "") & national.startswith(own["trunk"]), F.substr(national, F.length(own["trunk"]) + 1)).otherwise(national)
    home = F.when(fits(short, own), short)
    return F.when(digits != "", F.concat(F.lit("+"), found["code"], abroad)).otherwise(F.concat(F.lit("+"), own["code"], home))


def full_phone(raw: Column) -> Column:
    """Does it hold nine digits or more (O9.2)?"""
    return F.coalesce(F.length(F.regexp_replace(raw, "[^0-9]", "")) >= 9, F.lit(False))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal, composed of sha2 (O9.3)."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda byte: F.lit(bytearray(b ^ byte for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def mask_phone(x: Column) -> Column:
    """All stars up to five characters; else the first three and the last two stay (O9.4)."""
    n = F.length(x)
    return F.when(n <= 5, F.rpad(F.lit(""), n, "*")).otherwise(F.concat(F.substring(x, 1, 3), F.rpad(F.lit(""), n - 5, "*"), F.right(x, F.lit(2))))


def mask_tail(x: Column) -> Column:
    """Three stars and the last four digits, or three stars (O9.5)."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.concat(F.lit("***"), F.right(F.coalesce(digits, F.lit("")), F.lit(4)))


def redact(x: Column) -> Column:
    """Links become ``[URL REDACTED]``, then phones ``[PHONE REDACTED]`` (O9.17)."""
    return F.regexp_replace(F.regexp_replace(x, LINK, "[URL REDACTED]"), PHONE, "[PHONE REDACTED]")


def numbers(x: Column) -> Column:
    """Number tokens in order (O9.22)."""
    return F.regexp_extract_all(x, F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1))


def humanise(action: Column, entity: Column) -> Column:
    """``source_created`` and id to ``Source created (12345678)`` (O9.19)."""
    words = F.trim(F.replace(action, F.lit("_"), F.lit(" ")))
    text = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1_000_000)))
    return F.concat(text, F.lit(" ("), F.substring(entity, 1, 8), F.lit(")"))


def fold_key(x: Column) -> Column:
    """Compatibility forms, marks off, lower case, other runs to ``_`` (O9.20); ``age`` is named ``eta``.

    Characters that become one letter or digit are translated; those that become several (ligatures, fractions, numerals
    in circles) are looked up character by character, in texts that have any.
    """
    several = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.get(F.split(F.lit("\n".join(MORE_PLAIN)), "\n"), F.nullif(F.instr(F.lit(MORE), c), F.lit(0)) - 1), c)), "")
    x = F.when(F.length(F.translate(x, MORE, "")) < F.length(x), several).otherwise(x)
    bare = F.lower(F.translate(x, ONE + MARKS, ONE_PLAIN))  # marks have nothing to become
    key = F.btrim(F.regexp_replace(bare, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(key == "age", "eta").otherwise(key)


def encode_error(code: Column, message: Column) -> Column:
    return F.concat(F.lit("["), code, F.lit("] "), message)


def decode_error(text: Column) -> tuple[Column, Column]:
    """Code (null without a prefix) and message (O9.21)."""
    code = F.regexp_extract(text, r"^\[([a-z_]+)\] ", 1)
    return F.nullif(code, F.lit("")), F.regexp_replace(text, r"^\[[a-z_]+\] ", "")


def mime_type(content: Column) -> Column:
    """MIME type by magic numbers (O9.23)."""
    at = lambda first, n: F.hex(F.substring(content, first + 1, n))
    out = F.when((at(0, 4) == "52494646") & (at(8, 4) == "57454250"), "image/webp")
    boxed = (F.octet_length(content) >= 12) & (at(4, 4) == "66747970")
    out = out.when(boxed & (at(8, 4) == "71742020"), "video/quicktime").when(boxed, "video/mp4")
    for magic, kind in MAGIC:
        out = out.when(at(0, len(magic) // 2) == magic, kind)
    return out.otherwise("application/octet-stream")
