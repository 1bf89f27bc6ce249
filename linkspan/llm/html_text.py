"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks at every element that is not inline. The first pass decides blocks by
their number of words, the share of stop words among them and the share of their letters inside links. Blocks
of too few words, or of middling shares, stay open; the second pass gives them the label of the nearest
decided blocks of their part of the page. In scripts without spaces two letters count as a word, and where a page has next to
none of the stop words known here, whole sentences and length decide in their place.

Containers are one input beside these rules: menus, footers, adverts, forms and the like bar their blocks, unless
they wrap an article or would bar a page's whole text; and where articles hold a fair part of the text, the
rest of the page goes. A name of a container counts as a whole (``sidebar``, ``ad-slot``), not by a part of it
(``no-sidebar``, ``ad-free``). Reader comments are also known by their structure: siblings of one kind, each with a name, a date and a
short text, that follow the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not kept on the stack of open containers: their end tags are often left out.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup html body rp rt".split())
#: Containers that never hold the article's text, and those that may stand open or be put around a whole page by mistake.
OUTSIDE = frozenset("footer aside head noscript template svg canvas button select datalist dialog object iframe audio video map".split())
AROUND = frozenset("nav form menu header".split())
#: Names of unwanted containers; what such a name may end in; what makes a name say something about the page.
UNWANTED = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    alert alerts menu menus nav navbar navigation sidebar aside footer masthead breadcrumb breadcrumbs pagination pager comment comments commentlist
    disqus replies reply respond responses feedback legal disclaimer imprint impressum share sharing social related newsletter subscribe subscription signup login popup modal overlay skip toolbar widget widgets""".split()
)
ENDINGS = frozenset(
    """area bar block blocks body box button buttons card cards column container content form group inner item items label link links list panel post posts
    articles stories section slot text thread title unit wrap wrapper zone""".split()
)
STATES = frozenset("no not non has have with without is free open closed enabled disabled hide show page".split())
ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu\w*|form)\b", re.I)
MARKS = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|noframes|noembed)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>",
    re.I | re.S,
)
#: Frequent function words of the four languages.
STOP = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their them they this to was we were what when which who will with you
    aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht sich sie so und von vor war wie wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour que qui sa se ses son sur un une vous été
    al como con cuando de del donde el ella en es esta este ha la las lo los mas más me mi muy no o para pero por que se si sin sobre su sus también un una y ya""".split()
)
WORD = re.compile(r"\w+")
#: Letters of scripts that don't put spaces between words, and what ends a sentence in any script.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
SENTENCE = regex.compile(r"(?:\p{Sentence_Terminal}|…)[\p{Pe}\p{Pf}\p{Pi}\"'\s]*\Z")
#: A date or an age, as comments have them.
DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b|\b\d{1,2}\.? \w{3,10},? \d{4}\b|\b\w{3,10} \d{1,2},? \d{4}\b|\b\d+ \w+ ago\b|\bvor \d+ \w+|\bil y a \d+ \w+|\bhace \d+ \w+|\d+年\d+月\d+日|\b\d{1,2}:\d{2}\b", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words that a block needs to be decided by its density; words of a dense text that containers alone don't bar.
SHORT, MUCH = 10, 50
#: Different words, or letters of a script without spaces, from which a page tells whether its language is known.
ENOUGH = 25


@dataclass(eq=False)
class Node:
    """An element that holds blocks: the one around it, tag and class, and whether a ``time`` stands in it."""

    above: Node | None
    kind: str = ""
    dated: bool = False
    item: Node | None = None  # the list entry that is open in it


@dataclass(eq=False)
class Mark:
    """An unwanted container: why (``tag``, ``around`` or ``name``), the one around it, and whether it has an article."""

    why: str
    above: Mark | None
    wraps: bool = False


class Block(NamedTuple):
    text: str
    linked: int  # letters inside links
    mark: Mark | None  # the nearest unwanted container
    region: int  # number of the article, 0 outside


def n_words(text: str) -> int:
    """Words of a text; in scripts without spaces, two letters are one."""
    letters = len(UNSPACED.findall(text))
    return len(WORD.findall(text)) + letters // 2


def unwanted_name(name: str) -> bool:
    """Is a class or an id the name of an unwanted container?"""
    parts = [x for x in re.split("[-_]+", CAMEL.sub("-", name).lower()) if x]
    if not parts or STATES.intersection(parts):
        return False
    return parts[-1] in UNWANTED or parts[0] in UNWANTED and parts[-1] in ENDINGS


def _named(attributes: str) -> bool:
    names = (x for t in MARKS.findall(attributes) for part in t for x in part.split())
    return bool(ROLES.search(attributes) or HIDDEN.search(attributes)) or any(map(unwanted_name, names))


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """The blocks in page order, and for each article the one around it (0: none)."""
    return _read(html)[:2]


def _read(html: str) -> tuple[list[Block], list[int], list[Node]]:
    """``blocks``, and the element that holds each."""
    found: list[Block] = []
    nodes: list[Node] = []
    stack: list[tuple[str, Mark | None, int, Node]] = []  # tag, mark, region, node
    page = Node(None)
    parts: list[str] = []
    around = [0]
    linked, link, at = 0, -1, 0  # link: how deep the open link stands
    skip, depth = "", 0  # an inline element that isn't shown

    def end_block() -> None:
        nonlocal linked, depth
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                mark, region, node = stack[-1][1:] if stack else (None, 0, page)
                found.append(Block(text, linked, mark, region))
                nodes.append(node.item or node)
            parts.clear()
        linked = depth = 0

    def add(raw: str) -> None:
        nonlocal linked
        if not depth:
            text = unescape(raw)
            parts.append(text)
            if link >= 0:
                linked += len("".join(text.split()))

    for m in TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                link = -1 if m[2] else len(stack)
            elif tag == "br":
                parts.append(" ")
            elif tag == "time":
                node = stack[-1][3] if stack else page
                (node.item or node).dated = True
            if depth and tag == skip:
                depth += -1 if m[2] else 1
            elif not depth and not m[2] and m[4] and tag not in VOID and _named(m[4]):
                skip, depth = tag, 1
            continue
        end_block()
        holder = stack[-1][3] if stack else page
        if tag in VOID or tag in LOOSE:
            if tag == "li":
                holder.item = None if m[2] else Node(holder, "li")
            continue
        if m[2]:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
                link = link if link <= len(stack) else -1
            continue
        if m[4].endswith("/") and tag in ("path", "use", "rect", "circle"):
            continue
        mark, region = stack[-1][1:3] if stack else (None, 0)
        if tag in ("article", "main"):
            for _, x, _, _ in stack:
                if x and x.why != "tag":
                    x.wraps = True
            if not region or tag == "article" and any(s[0] == "article" for s in stack):
                around.append(region)
                region = len(around) - 1
        elif tag in OUTSIDE:
            mark = Mark("tag", mark)
        elif tag in AROUND and not (tag == "header" and region):
            mark = Mark("around", mark)
        if m[4] and _named(m[4]):
            mark = Mark("name", mark)
        stack.append((tag, mark, region, Node(holder.item or holder, f"{tag} {m[4]}" if len(m[4]) < 200 else tag)))
    if at < len(html):
        add(html[at:])
    end_block()
    return found, around, nodes


def rule(words: int, stop: float, link: float, sentence: bool, inside: bool, known: bool = True) -> bool | None:
    """A block's label by its words, shares of stop words and of letters in links, and whether it ends as a
    sentence does; inside an article, links and few stop words weigh less. Where the page's language isn't ``known``, sentences
    and length count instead of stop words. None: open."""
    if link > (0.8 if inside else 0.5):
        return False
    if words < SHORT or link > 0.33:
        return None
    if not known and (sentence or words >= 40):
        return True
    if stop >= 0.2 or words >= 40 and stop >= 0.1:
        return True
    return False if stop < 0.05 and not sentence and not inside else None


def comments(page: list[Block], nodes: list[Node]) -> set[int]:
    """Blocks of reader comments, by structure alone: two siblings of one kind or more, each with a date, a name of up to four
    words or both in one line, and up to 150 words of text; they follow twenty words of other text at least."""
    groups: dict[tuple, dict[Node, list[int]]] = defaultdict(lambda: defaultdict(list))
    words = [n_words(b.text) for b in page]
    for i, x in enumerate(nodes):
        for _ in range(6):
            if x is None or x.above is None:
                break
            groups[x.above, x.kind][x].append(i)
            x = x.above
    found: set[int] = set()
    for (above, kind), items in groups.items():
        if not kind or len(items) < 2:
            continue
        first = min(at[0] for at in items.values())
        like = sum(_is_comment(page, nodes, words, x, at) for x, at in items.items())
        if 5 * like >= 4 * len(items) and like >= 2 and sum(words[:first]) >= 20:
            found.update(i for at in items.values() for i in at)
    return found


def _is_comment(page: list[Block], nodes: list[Node], words: list[int], item: Node, at: list[int]) -> bool:
    head = [i for i in at if words[i] <= 12 and not SENTENCE.search(page[i].text)]
    dated = any(nodes[i].dated or DATE.search(page[i].text) for i in head) or item.dated
    named = any(0 < words[i] <= 12 and WORD.search(DATE.sub("", page[i].text)) for i in head)
    body = sum(words[i] for i in at if i not in head)
    return dated and named and len(at) > 1 and 0 < body <= 150


def decide(page: list[Block], around: list[int], passing: tuple[str, ...] = (), replies: set[int] = frozenset()) -> list[tuple[bool, str]]:
    """Each block's label and what gave it: rule, neighbour, container or structure. Marks ``passing`` don't bar; ``replies`` go."""
    labels: list[bool | None] = []
    why: list[str] = []
    size = [len(b.text) - b.text.count(" ") for b in page]
    barred, shares = [], []
    for i, b in enumerate(page):
        x = b.mark
        while x and (x.wraps or x.why in passing):
            x = x.above
        barred.append(x is not None or i in replies)
        words = WORD.findall(b.text.lower())
        shares.append((n_words(b.text), sum(w in STOP for w in words), b.linked / max(1, size[i])))
        why.append("container" if x else "structure" if i in replies else "rule")
    told = [(n, stop, i) for i, ((n, stop, link), bar) in enumerate(zip(shares, barred)) if not bar and n >= SHORT and link <= 0.33]
    plain = sum(stop for _, stop, _ in told) < 0.05 * sum(n for n, _, _ in told)  # next to no stop words known here
    known = not plain or len({w for _, _, i in told for w in (*WORD.findall(page[i].text.lower()), *UNSPACED.findall(page[i].text))}) < ENOUGH
    for b, (n, stop, link), bar in zip(page, shares, barred):
        by_rule = False if b.text[0] == "©" else rule(n, stop / max(n, 1), link, bool(SENTENCE.search(b.text)), b.region > 0, known)
        labels.append(False if bar else by_rule)
    before = _nearest(page, labels, barred, range(len(page)))
    after = _nearest(page, labels, barred, range(len(page) - 1, -1, -1))
    free, dense = defaultdict(int), 0
    for b, letters, bar, label in zip(page, size, barred, labels):
        if not bar:
            free[b.region] += letters - b.linked
            dense += letters if label and not b.region else 0
    inside = sum(n for r, n in free.items() if r)
    largest = max((n for r, n in free.items() if r), default=0)
    articles = len(around) > 1 and 4 * inside >= dense
    out = []
    for i, b in enumerate(page):
        label = labels[i]
        if label is None:
            sides = [x for x in (before[i], after[i]) if x]
            near = min((d for d, _ in sides), default=0)
            label, why[i] = (any(v for d, v in sides if d == near), "neighbour") if sides else (True, "container")
        if label and articles:
            outer = around[b.region]
            if not b.region or 5 * free[b.region] < largest or outer and free[outer] >= free[b.region]:
                label, why[i] = False, "container"
        out.append((label, why[i]))
    return out


def _nearest(page, labels, barred, order) -> list[tuple[int, bool] | None]:
    """For each block: distance and label of the last decided one on the way, of the same article and not barred."""
    seen: dict[int, tuple[int, bool]] = {}
    out: list[tuple[int, bool] | None] = [None] * len(page)
    for i in order:
        region = page[i].region
        if region in seen:
            out[i] = (abs(i - seen[region][0]), seen[region][1])
        if labels[i] is not None and not barred[i]:
            seen[region] = (i, labels[i])
    return out


def main_blocks(html: str | None) -> list[tuple[Block, bool, str]]:
    """Blocks of a page with their labels and what gave them.

    If containers bar all of a page whose dense blocks have ``MUCH`` words or more, names of containers are passed
    over, and then forms and menus: they stand around the page or were never closed.
    """
    page, around, nodes = _read(html or "")
    replies = comments(page, nodes)
    found: list[tuple[bool, str]] = []
    for passing in ((), ("name",), ("name", "around")):
        decided = decide(page, around, passing, replies)
        kept = [b for b, (label, _) in zip(page, decided) if label]
        if not passing or sum(n_words(b.text) for b in kept) >= MUCH:
            found = decided
        if kept:
            break
    else:
        found = _densest(page, found)
    return [(b, *d) for b, d in zip(page, found)]


def _densest(page: list[Block], found: list[tuple[bool, str]]) -> list[tuple[bool, str]]:
    """Labels of a page that has none kept: its blocks with few links that no container bars, if they hold ``MUCH`` words or 200 letters."""
    dense = [why not in ("container", "structure") and b.text[0] != "©" and b.linked <= 0.33 * len(b.text) and n_words(b.text) >= SHORT for b, (_, why) in zip(page, found)]
    kept = [b.text for b, ok in zip(page, dense) if ok]
    if sum(map(n_words, kept)) < MUCH and sum(len(WORD.findall(t)) and len("".join(WORD.findall(t))) for t in kept) < 200:
        return found
    return [(ok, "rule" if ok else why) for ok, (_, why) in zip(dense, found)]


def main_text(html: str | None) -> str:
    return " ".join(b.text for b, label, _ in main_blocks(html) if label)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    Null or empty html gives the empty text; null ids and urls stay null; repeated rows each keep their
    row; very long pages are read whole; other columns are ignored; an empty table gives no rows. A page without any
    decided block keeps its open ones, so that a bare line of text is not lost. Of two decided neighbours
    equally near, one that is text wins.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
