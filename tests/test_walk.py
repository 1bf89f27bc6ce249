"""The walk over listing pages and the paths that select their links."""

from __future__ import annotations

import pytest

from linkspan.operators import html, walk, xpath

PAGE = """<section class="detail"><dl><dt>Age</dt><dd>26</dd></dl></section><section class=clip><img src="/p.jpg"><video src="/v.mp4"></video></section>
<article class="review"><b>Ada</b><p>Good</p></article><article class="review hot"><b>Lin</b><p>So <i>so</i></p><a href="/1">x</a><a>y</a></article>"""


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("//section[@class='detail']//dt", ["Age"]), ("//article[contains(@class, 'review')]/b", ["Ada", "Lin"]), ("//article[@class='review']/p", ["Good"]), ("//article[2]/p", ["So so"]),
        ("//article[last()]/b/text()", ["Lin"]), ("//a[@href]", ["x"]), ("//a[not(@href)]", ["y"]), ("//a/@href", ["/1"]), ("//img/@src | //video/@src", ["/p.jpg", "/v.mp4"]), ("//i/..", ["So so"]),
        ("//p[text()='Good']", ["Good"]), ("//p[.='So so']", ["So so"]), ("//article[b='Lin' and a]/b", ["Lin"]), ("//article[b='Lin' or b=\"Ada\"]/b", ["Ada", "Lin"]), ("//*[starts-with(@src, '/p')]/@src", ["/p.jpg"]),
        ("//article//*[normalize-space(.)='Lin']", ["Lin"]), ("//article/p/../b", ["Ada", "Lin"]), ("//dd[position()=1]", ["26"]), ("//article[b!='Ada']/b", ["Lin"]), ("//nothing", []), ("//section/*/dt", ["Age"]), ("/section[1]/dl/dd", ["26"]), ("//article/a[2]", ["y"]), ("//a[1]", ["x"]),
    ],
)
def test_paths(path, want):
    assert [html._value(e, "text") for e in html.select(html.parse(PAGE), path)] == want


def test_paths_from_inside_an_element():
    """The same containers, keys and values by paths as by selectors."""
    root = html.parse(PAGE)
    assert html.Pairs("//section[@class='detail']", ".//dt", ".//dd").read(root) == [("Age", "26")]
    assert html.Items("//section[@class='clip']", "poster=.//img@src;video=./video@src").read(root) == [[("poster", "/p.jpg"), ("video", "/v.mp4")]]
    assert html.Items("//article", "author=xpath:b@text;text=.//p@text").read(root) == [[("author", "Ada"), ("text", "Good")], [("author", "Lin"), ("text", "So so")]]
    inner = html.select(root, "article.hot")[0]
    assert [e.tag for e in html.select(inner, "./a")] == ["a", "a"] and len(html.select(inner, "//article")) == 2  # a slash starts at the page


@pytest.mark.parametrize("path", ["//a[", "//a[foo()]", "//a[@x=]", "//a[contains(@x)]", "ancestor::a", "//a[1 + 1]", "//a//", "//a[count(b) > 1]", "xpath:$x"])
def test_other_paths_are_errors(path):
    with pytest.raises(ValueError, match="not supported"):
        xpath.find(html.parse(PAGE), path.removeprefix("xpath:"))


def test_child_selectors_and_attribute_values():
    root = html.parse('<div id="a"><p><b data-k="x y">1</b></p><b data-k=z>2</b></div>')
    texts = lambda s: [html.element_text(e) for e in html.select(root, s)]
    assert texts("div > b") == ["2"] and texts("div b") == ["1", "2"] and texts("#a>p>b") == ["1"] and texts("div > p b[data-k]") == ["1"]
    assert texts('b[data-k="x y"]') == ["1"] and texts("b[data-k=z]") == ["2"] and texts("p > div b") == []


def site(pages):
    return [(u, "".join(f'<a class="ad" href="{a}">x</a>' for a in ads) + "".join(f'<a class="next" href="{n}">n</a>' if n is not None else '<a class="next">n</a>' for n in nexts)) for u, ads, nexts in pages]


def test_walks(spark):
    s = "https://a.example"
    pages = site([
        (f"{s}/1", ["/ad1", "/ad2", "/ad1"], ["/2#top"]), (f"{s}/2", ["/ad2", "/ad3"], ["?x#a", f"{s}/2?x"]), (f"{s}/2?x", ["/ad4"], []),
        (f"{s}/loop", [], ["/loop2"]), (f"{s}/loop2", ["/l"], ["/loop#again"]), (f"{s}/two", [], ["/1", "/2"]), (f"{s}/mixed", [], ["/1", None]), (f"{s}/click", [], [None]),
        (f"{s}/away", [], ["http://a.example/1"]), (f"{s}/lost", [], ["/nowhere"]), (f"{s}/port", [], ["https://A.example:443/2?x"]), *[(f"{s}/c{i}", [f"/c-ad{i}"], [f"/c{i + 1}"]) for i in range(9)],
    ])
    links = walk.listing_links(spark.createDataFrame(pages, "url string, html string"), "url", "html", "//a[contains(@class, 'ad')]", "a.next")
    starts = [(i, 0, f"{s}/{p}") for i, p in enumerate(["1", "loop", "two", "mixed", "click", "away", "lost", "port", "c0", "gone"])] + [(20, 0, f"{s}/c0"), (20, 1, f"{s}/1"), (20, 2, f"{s}/2"), (None, 0, f"{s}/2")]
    walks, adverts = walk.walk(spark.createDataFrame(starts, "source_id int, start_no int, start_url string"), links, max_pages=4, max_ads=6)
    got = {(r.source_id, r.start_no): (r.pages_visited, r.stop_reason) for r in walks.collect()}
    assert got == {
        (0, 0): (3, "end_of_pagination"), (1, 0): (2, "repeated_page"), (2, 0): (1, "ambiguous_next_control"), (3, 0): (1, "ambiguous_next_control"), (4, 0): (1, "click_requires_browser"), (5, 0): (1, "cross_origin_blocked"),
        (6, 0): (1, "fetch_failed"), (7, 0): (1, "fetch_failed"), (8, 0): (4, "max_pages"), (9, 0): (0, "fetch_failed"), (20, 0): (4, "max_pages"), (20, 1): (1, "max_ads"), (None, 0): (2, "end_of_pagination"),
    }
    found = {}
    for r in sorted(adverts.collect(), key=lambda r: r.ordinal):
        found.setdefault(r.source_id, []).append((r.url.removeprefix(s), r.page_number))
    assert found[0] == [("/ad1", 1), ("/ad2", 1), ("/ad3", 2), ("/ad4", 3)]
    assert found[20] == [("/c-ad0", 1), ("/c-ad1", 2), ("/c-ad2", 3), ("/c-ad3", 4), ("/ad1", 1), ("/ad2", 1)]
    assert found[1] == [("/l", 2)] and found[None] == [("/ad2", 1), ("/ad3", 1), ("/ad4", 2)]
