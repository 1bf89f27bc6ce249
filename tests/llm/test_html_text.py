from __future__ import annotations

import random
from collections import Counter
from html.parser import HTMLParser

import duckdb
import pytest

from linkspan.llm import html_text
from linkspan.llm.html_text import blocks, extract_text, main_text, unwanted_name

BODY = "This is the first paragraph of the text and it has all of the words that one would want."
MORE = "And here is another one, which is as long as the first was, with the same kind of words in it."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<article><h1>Title here</h1><p>{BODY}</p><p>{MORE}</p></article>", f"Title here {BODY} {MORE}"),
        (f"<nav><a href=/>Home</a></nav><header>The site</header><article><p>{BODY}</article><footer>&copy; someone</footer>", BODY),
        (f"<div class=sidebar><p>{MORE}</p></div><main><p>{BODY}</p><div class='ad banner'>{MORE}</div><section id=comments><p>{MORE}</p></section></main>", BODY),
        (f"<script>var x='<p>{MORE}</p>'</script><style>p{{}}</style><!-- <p>{MORE}</p> --><article><p>{BODY}<form><p>{MORE}</p></form></article>", BODY),
        ("<article><p>a &lt;b&gt; &amp;amp; caf&eacute;&nbsp;&#x1F600;\n\t x y z w v</p></article>", "a <b> &amp; café 😀 x y z w v"),
        (f"<article><p>one two <b>three</b>four <i>five</i> six</p><p>{BODY}</p></article>", f"one two threefour five six {BODY}"),
        (f"<article><p>{BODY}</p><p>Short.</p><p>{MORE}</p></article>", f"{BODY} Short. {MORE}"),
        (f"<p>{BODY}</p><p>Short.</p><p>{MORE}</p><ul><li><a href=x>one link here</a></li><li><a href=y>and another link</a></li></ul>", f"{BODY} Short. {MORE}"),
        (f"<article><p title=don't data-x=\"a > b\">{BODY}</p></article>", BODY),
        (f"<article><p>{BODY}</p><div hidden>{MORE}</div><div class='cookie-notice'>{MORE}</div></article>", BODY),
        (f"<article><p>{BODY}", BODY), ("", ""), (None, ""), ("   ", ""), ("<p></p><br>", ""), ("just a line", "just a line"),
        ("<article><p>x</p></article>", "x"),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


def test_links_count_without_spaces():
    assert blocks("<p>see <a href=x>a b</a> c</p>") == ([("see a b c", 2, None, 0)], [0])
    page, _ = blocks("<a href=x><div>a block</div></a><div>b</div><div><a href=y>c</div><div>d</div>")
    assert [(b.text, b.linked) for b in page] == [("a block", 6), ("b", 0), ("c", 1), ("d", 0)]


def test_long_and_broken_pages():
    big = "<article>" + f"<p>{BODY}</p>" * 5000
    assert main_text(big).count("first paragraph") == 5000
    main_text("<a '" * 5000)
    main_text("<div>" * 5000 + BODY)
    main_text("<p x=\"" + "y" * 100_000)


def test_table(spark):
    page = f"<article><p>{BODY}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "5 as text", "6 as `n chars`")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_text(d).collect()), key=repr)
    assert got == sorted([(1, "u", BODY, len(BODY))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract_text(d.where("false")).count() == 0


class Tree(HTMLParser):
    """Texts between elements that aren't inline, with the open containers around each."""

    def __init__(self, html):
        super().__init__()
        self.open, self.found, self.now, self.links, self.a, self.number = [], [], "", 0, None, 0
        self.feed(html)
        self.close()
        self.cut()

    def cut(self):
        if text := " ".join(self.now.split()):
            self.found.append((text, self.links, list(self.open)))
        self.now, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.a = len(self.open)
        if tag == "br":
            self.now += " "
        if tag not in html_text.INLINE:
            self.cut()
            if tag not in html_text.VOID | html_text.LOOSE:
                self.number += 1
                self.open.append((tag, " ".join(v or "" for k, v in attrs if k in ("class", "id")), self.number))

    def handle_endtag(self, tag):
        if tag == "a":
            self.a = None
        if tag not in html_text.INLINE:
            self.cut()
            if tag in [t for t, _, _ in self.open]:
                while self.open.pop()[0] != tag:
                    pass
                if self.a is not None and self.a > len(self.open):
                    self.a = None

    def handle_data(self, data):
        if not self.open or self.open[-1][0] not in ("script", "style", "title"):
            self.now += data
            self.links += len("".join(data.split())) if self.a is not None else 0


def plainly(html):
    """The two passes, block by block over all others; for pages without nested articles and whole-page containers."""
    page = Tree(html).found
    articles = {x[2] for _, _, around in page for x in around if x[0] in ("article", "main")}
    with_article = {x[2] for _, _, around in page for i, x in enumerate(around) if any(y[2] in articles for y in around[i + 1 :])}
    rows = []
    for text, linked, around in page:
        inside = [x[2] for x in around if x[2] in articles]
        bad = [x for i, x in enumerate(around) if x[0] in html_text.OUTSIDE]
        bad += [x for i, x in enumerate(around) if x[0] in html_text.AROUND and x[2] not in with_article and not (x[0] == "header" and any(y[2] in articles for y in around[:i]))]
        bad += [x for x in around if x[2] not in with_article and any(unwanted_name(n) for n in x[1].split())]
        words = html_text.WORD.findall(text.lower())
        letters = len("".join(text.split()))
        stop = sum(w in html_text.STOP for w in words) / max(1, len(words))
        label = None
        if bad or text[0] == "©" or linked / letters > (0.8 if inside else 0.5):
            label = False
        elif len(words) >= 10 and linked / letters <= 0.33 and (stop >= 0.2 or len(words) >= 40 and stop >= 0.1):
            label = True
        elif len(words) >= 10 and linked / letters <= 0.33 and stop < 0.05 and not inside and text.rstrip("\"')»”’ ")[-1:] not in tuple(".!?…"):
            label = False
        rows.append([text, label, bool(bad), inside[0] if inside else 0, letters - linked])
    free = Counter()
    for _, _, bad, region, n in rows:
        free[region] += 0 if bad else n
    dense = sum(n for _, label, bad, region, n in rows if label and not bad and not region)
    within = sum(n for r, n in free.items() if r)
    out = []
    for i, (text, label, bad, region, _) in enumerate(rows):
        if label is None:
            others = [(abs(i - j), x) for j, (_, x, b, r, _) in enumerate(rows) if x is not None and not b and r == region]
            label = any(x for d, x in others if d == min(others)[0]) if others else True
        if articles and 4 * within >= dense and (not region or 5 * free[region] < max(free[r] for r in free if r)):
            label = False
        if label:
            out.append(text)
    return " ".join(out)


def test_against_a_plain_form():
    pages = [h for (h,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    assert [main_text(h) for h in pages] == [plainly(h) for h in pages]
    r = random.Random(4)
    words = "the of and in river stone walk light quiet letters home green as is was 2024 &amp; x".split()
    texts = ["Short.", "© someone", "Menu | One | Two", "name value name value name value name value name value"]
    for _ in range(600):
        some = lambda: r.choice([*texts, " ".join(r.choice(words) for _ in range(r.choice([3, 12, 45]))) + r.choice([".", ""])])
        bits = []
        for _ in range(r.randrange(1, 9)):
            x = r.choice([some(), f"<a href=x>{some()}</a>", f"<p>{some()} <a href=y>{some()}</a></p>", f"<p>{some()}<br>{some()}", f"<li>{some()}", f"<h2>{some()}</h2>"])
            x = r.choice([x, x, f"<div>{x}</div>", f"<div class='{r.choice(['comments', 'no-sidebar', 'ad-slot', 'text', 'post ad-free'])}'>{x}</div>", f"<nav>{x}</nav>", f"<footer>{x}</footer>"])
            bits.append(x)
        k = r.randrange(len(bits))
        html = r.choice(["".join(bits), "".join(bits[:k]) + f"<article>{''.join(bits[k:])}</article>", f"<div class=page-with-share><header>x y</header><main><header><h1>T</h1></header>{''.join(bits)}</main></div>"])
        if any(label for label, _ in html_text.decide(*blocks(html))):  # else containers are passed over
            assert main_text(html) == plainly(html), html


def test_rules_agree_where_articles_are_plain_divs():
    """Container hints decide little: with <article> renamed, nearly the same words stay."""
    pages = [h for (h,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    both = kept = 0
    for h in pages:
        a, b = (Counter(main_text(x).split()) for x in (h, h.replace("<article", "<div").replace("</article", "</div")))
        both, kept = both + 2 * (a & b).total(), kept + a.total() + b.total()
    assert both / kept >= 0.97


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar content", "post ad-free", "comments-open", "page-with-share", "content-widget-area", "notice-page", "sidebar"])
def test_wrappers_keep_their_text(name):
    much = " ".join([BODY, MORE] * 3)
    assert main_text(f'<div class="{name}"><article><p>{much}</p></article></div>') == much
    assert main_text(f'<div class="{name}"><p>{much}</p></div>') == much


@pytest.mark.parametrize("name", ["ad", "ad-slot", "cookieBanner", "site-footer", "comment-list", "related-posts", "main-nav", "newsletter-signup", "sidebar"])
def test_unwanted_names(name):
    assert main_text(f"<p>{BODY}</p><div class={name}><p>{MORE}</p></div>") == BODY


def test_odd_containers():
    much = " ".join([BODY, MORE] * 3)
    assert main_text(f"<nav><a href=x>Home</a><article><p>{much}</p></article>") == much  # never closed
    assert main_text(f"<form><div><p>{much}</p></div></form>") == much
    assert main_text(f"<article><p>{much}</p><article><p>{BODY}</p></article></article>") == much  # a reader's comment or a teaser
    assert main_text(f"<article><p>{BODY} <span style='display:none'>not <span>this</span> one</span><span class=ad>nor this</span></p></article>") == BODY
    assert main_text(f"<p>{much}</p><a href=x><div>{MORE}</div></a>") == much
    assert main_text("<nav><a href=x>Home</a></nav><footer>All of the rights are with the owner of the site and of the text on it.</footer>") == ""


SCRIPTS = {
    "zh": ("这是第一段文字，它讲述了一个很长的故事。", "人们在城市里工作，也在那里生活，他们每天都乘坐公共汽车。"),
    "ja": ("これは最初の段落であり、とても長い話をしています。", "人々は町で働き、そこで暮らし、毎日バスに乗っています。"),
    "th": ("นี่คือย่อหน้าแรกซึ่งเล่าเรื่องยาวมากเกี่ยวกับผู้คนในเมืองใหญ่และชีวิตของพวกเขา", "ผู้คนทำงานในเมืองและอาศัยอยู่ที่นั่นทุกวันพวกเขานั่งรถเมล์ไปทำงานด้วยกันเสมอ"),
    "ar": ("هذه هي الفقرة الأولى من النص وهي تروي قصة طويلة جدا عن الناس في المدينة.", "يعمل الناس في المدينة ويعيشون هناك ويركبون الحافلة كل يوم إلى عملهم."),
    "ru": ("Это первый абзац текста, и он рассказывает очень длинную историю о людях в городе.", "Люди работают в городе и живут там, и каждый день они ездят на автобусе."),
    "it": ("Questo è il primo paragrafo del testo e racconta una storia molto lunga di persone in città.", "Le persone lavorano in città e ci vivono, e ogni giorno prendono l'autobus per andare al lavoro."),
    "hi": ("यह पाठ का पहला अनुच्छेद है और यह शहर के लोगों की एक बहुत लंबी कहानी बताता है।", "लोग शहर में काम करते हैं और वहीं रहते हैं और हर दिन बस से जाते हैं।"),
}


@pytest.mark.parametrize("lang", SCRIPTS)
@pytest.mark.parametrize("article", [True, False])
def test_pages_in_any_script(lang, article):
    one, two = SCRIPTS[lang]
    body = "".join(f"<p>{x * 4}</p>" for x in (one, two, one))
    inside = f"<article>{body}</article>" if article else f"<div class=text>{body}</div>"
    menu = "".join(f"<li><a href=/{i}>{two[:12]}</a></li>" for i in range(8))
    page = f"<nav><ul>{menu}</ul></nav><div class=top><ul>{menu}</ul></div>{inside}<div id=legal-notice><p>{two}</p></div><footer>{one}</footer>"
    assert main_text(page) == " ".join(x * 4 for x in (one, two, one))


@pytest.mark.parametrize("lang", SCRIPTS)
def test_no_page_of_prose_is_empty(lang):
    one, two = SCRIPTS[lang]
    for page in (f"<div><p>{(one + ' ' + two) * 10}</p></div>", f"<body>{(two + ' ') * 20}", f"<div>{''.join(f'<p>{one}</p>' for _ in range(20))}</div>"):
        assert len(main_text(page)) >= 200
    bare = "".join(c for c in one * 20 if c.isalpha())  # no sign and no space at all
    assert main_text(f"<div><p>{bare}</p></div>") == bare


def reply(who, when, text, tag="div", cls="entry"):
    return f"<{tag} class={cls}><div class=a>{who}</div><div class=b>{when}</div><p>{text}</p></{tag}>"


def test_comments_by_structure():
    """Containers of names that say nothing; siblings with a name, a date and a short text."""
    replies = [("Ada Byron", "3 May 2024", "I like this text a lot and would read more of it."), ("Lin", "2 hours ago", "So do I."), ("Bo", "<time>now</time>", "This is not what I had thought of it at all.")]
    article = f"<article><h1>Title here</h1><p>{BODY}</p><p>{MORE}</p>%s</article>"
    want = f"Title here {BODY} {MORE}"
    for tag, wrap in (("div", "<div class=user-talk>%s</div>"), ("section", "%s"), ("li", "<ul class=x>%s</ul>")):
        page = article % (wrap % "".join(reply(*r, tag=tag) for r in replies))
        assert main_text(page) == want, tag
    assert "structure" in {w for _, _, w in html_text.main_blocks(page)}
    # One dated box, and sections without names or dates, are text.
    assert "So do I" in main_text(article % reply("Lin", "2 hours ago", "So do I. And this is what one would say of it."))
    sections = "".join(f"<section class=part><h2>Part {i}</h2><p>{MORE}</p></section>" for i in range(3))
    assert main_text(article % sections).count(MORE) == 4
    # A text that begins with dated entries keeps them: nothing stands before.
    assert BODY in main_text("<article>" + "".join(reply("Day", f"{i} May 2024", BODY) for i in range(1, 4)) + "</article>")


def test_notices_outside_articles():
    legal = "All rights of this text are with us and you may not use it in any way that we have not said."
    assert main_text(f"<div><p>{BODY}</p><p>{MORE}</p></div><div class=legal><p>{legal}</p></div>") == f"{BODY} {MORE}"
