"""Operator 12: wrappers against plain versions, layouts without telling names, awkward pages."""

import collections
import html
import random
import re
import time

import pytest

from cladewise.llm import common, queries, wrapper
from cladewise.llm.wrapper import Matching, Node, Page, align, fold, in_order, induced, main_text, read_tree, write_tree

from .test_operators import SF


def plain_article(page):
    """The given pages have one article of paragraphs and a heading, never closed b and p, and no other markup in it."""
    body = re.search(r"<article>(.*)</article>", page, re.DOTALL).group(1)
    blocks = (html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split() for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(" ".join(b) for b in blocks if b)


def test_given_pages_against_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.page_id, r.url, t := plain_article(r.html), len(t)) for r in pages.collect()}
    out = queries.queries()["op12_html_extraction"](spark, SF)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: tuple(r) for r in out.collect()} == want


def tree(rng, depth=3):
    node = Node(rng.choice("ab"), None)
    for _ in range(rng.randrange(0, 4) if depth else 0):
        child = tree(rng, depth - 1)
        child.parent = node
        node.children.append(child)
    return node


def plain_matching(a, b):
    """The recursion that defines simple tree matching."""
    if a.sig != b.sig:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_matching(x, y))
    return m[-1][-1] + 1


def test_matching_is_the_largest():
    rng = random.Random(4)
    for _ in range(400):
        a, b = tree(rng), tree(rng)
        if a.sig == b.sig:
            assert Matching().pairs(a, b)[0] == plain_matching(a, b)
            for k, x in enumerate(in_order(b)):
                x.number = k
            align(a, b)
            held = [x for x in in_order(a) if x.number >= 0]
            partner = dict(enumerate(in_order(b)))
            assert len(held) == plain_matching(a, b) and len({x.number for x in held}) == len(held)
            assert all(x.sig == partner[x.number].sig for x in held)
            assert all(x.parent.number == in_order(b).index(partner[x.number].parent) for x in held if x.parent and x is not a)


def test_wide_nodes_are_aligned_from_the_left(monkeypatch):
    monkeypatch.setattr(wrapper, "PAIRS", 3)
    a, b = (read_tree(write_tree(fold(Page(h).top))) for h in ("<p>1</p><h2>2</h2><p>3</p><h3>4</h3>", "<h2>2</h2><p>3</p><h2>2</h2><h3>4</h3>"))
    size, pairs = Matching().pairs(a, b)
    assert size == 1 + len(pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs) >= 2


def test_trees_and_merging():
    told = [write_tree(fold(Page(h).top)) for h in ("<body><div class=a><p>x<p>y</div><footer>f", "<body><h1>t</h1><div class=a><p>z</p><ul><li>1<li>2</ul></div>", "<body><div class=b>q")]
    assert write_tree(read_tree(told[0])) == told[0]
    made = read_tree(induced(told))
    assert sorted(x.sig for x in in_order(made)) == sorted(["", "body", "h1", "div a", "p", "ul", "li", "div b", "footer"])
    for one in told:
        page = read_tree(one)
        align(page, made)
        assert all(x.number >= 0 for x in in_order(page))


WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod".split()


def said(rng, n=12):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def unnamed(rng, own, extra=""):
    """A layout whose names say nothing: bar, text and promise come as divs."""
    blocks = [said(rng) for _ in range(rng.randrange(1, 5))]
    page = f"<html><body><div class=x1><div>Start</div><div>News</div></div><div class=x2><h1>{own}</h1>" + "".join(f"<div class=x3>{b}</div>" for b in blocks) + f"{extra}</div><div class=x4>All prices include <b>tax</b>.</div></body></html>"
    return page, "\n".join([own, *blocks])


@pytest.mark.parametrize("sent", [0, 8 << 20])
def test_what_stays_the_same_goes(spark, monkeypatch, sent):
    monkeypatch.setattr(wrapper, "SENT", sent)
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        page, text = unnamed(rng, f"Title {i}")
        rows.append((i, f"https://a.example/{i}", page))
        want[i] = text
    # copies of one article: one content, so nothing looks constant
    page, text = unnamed(rng, "The one")
    for i in range(100, 130):
        rows.append((i, f"http://user@B.example:80/{i}", page))
        want[i] = "Start\nNews\n" + text + "\nAll prices include tax."
    # copies within a host that has others: its template is known
    for i in range(130, 190):
        rows.append((i, "https://A.EXAMPLE/copy", page))
        want[i] = text
    for i, url in enumerate((None, "", "nowhere", "mailto:x"), 200):
        rows.append((i, url, page))
        want[i] = "Start\nNews\n" + text + "\nAll prices include tax."
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r for r in wrapper.extract(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert {i: r.url for i, r in got.items()} == {r[0]: r[1] for r in rows} and all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("  \n ", ""),
        ("plain &lt;text&gt; &amp; more", "plain <text> & more"),
        ("<p>a&nbsp; b\n\tc<br>d<p>e<i>f</i>g", "a b c d\nefg"),
        ("<head><title>t</title><p>no body", "no body"),
        ("<header><h1>Site</h1></header><main><header><h1>Own</h1></header><p>x</p><aside>y</aside></main>", "Own\nx"),
        ("<div class='layout with-sidebar'><article><p>x</article><div class=sidebar>s</div></div>", "x"),
        ("<article><p>x<button>Share</button> y<p>z</article><article class=comment>c</article>", "x y\nz"),
        ("<article><p>x</p><div id=comments><article>reader</article></div></article>", "x"),
        ("<article><h1>t</h1><p>x</article><section><article>teaser</article><article>teaser</article></section>", "t\nx"),
        ("<main><h1>t</h1><p>intro</p><article><p>x</article></main>", "t\nx"),
        ("<div class=post-header><h1>t</h1></div><p>x<div class=cookieNotice>c</div><form>f<p>g</form><p>y", "t\nx\ny"),
        ("<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>x <a href=4>y</a>", "x y"),
        ("<article><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", "one\ntwo\nthree"),
        ("<p>a<script>if (a</b>c) '</p>'</script>b<style>p{}</style><!-- <p>no --><![CDATA[x]]>c", "abc"),
        ("<p title='a>b' class=\"c>d\">x</p><p data-class=ad>y<p class=AD>z", "x\ny"),
        ("<table><tr><td>1<td>2<tr><th>3</table><dl><dt>4<dd>5</dl>", "1\n2\n3\n4\n5"),
        ("<p>x<svg><title>s</title><text>t</text></svg>y</p></div></b></x><p>z<nav>n", "xy\nz"),
        ("<p>x</p><!-- never closed <p>y", "x"),
        ("<p>x<script>never closed <p>y", "x"),
        ("a < b and c<3 </ >d<", "a < b and c<3 d<"),
        ("&#0;&#xD800;&unknown; &copy", "��&unknown; ©"),
    ],
)
def test_markup(page, text):
    assert main_text(Page(page), None) == text


def test_reading_takes_time_in_proportion():
    kinds = ('<a "', "<a '", '<p ="', "<div>", "<li><div>", "<b", "</b>", "<!--", "<script>", '<a x=">', "<div class=a><p>x</p></div><h2>y</h2>", "&amp", "<td><table>", "<p class=x don't>it", "<button>", "<article>")
    wide = read_tree(write_tree(fold(Page(kinds[10] * 3000).top)))
    assert len(in_order(wide)) == wrapper.NODES
    for kind in kinds:
        began = time.perf_counter()
        text = kind * 60_000
        page = Page(text)
        main_text(page, write_tree(wide))
        assert time.perf_counter() - began < 40, kind


def test_awkward_tables(spark):
    page = "<article>x</article>"
    rows = [(1, "http://h.example/", page, "a", "b"), (1, "http://h.example/", page, "a", "b"), (None, None, None, None, None), (2, "http://h.example/2", None, "", ""), (3, "http://h.example/3", "<nav>only</nav>", "", ""), (4, None, "<p>" + "long " * 300_000, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, HTML string, text string")
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in wrapper.extract(pages).collect())
    long = ("long " * 300_000).strip()
    assert got == collections.Counter([(1, "http://h.example/", "x", 1)] * 2 + [(None, None, "", 0), (2, "http://h.example/2", "", 0), (3, "http://h.example/3", "", 0), (4, None, long, len(long))])
    empty = wrapper.extract(pages.where("false"))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]
    named = common.pick(pages, "page_id", "url", "html").withColumnRenamed("url", "host")
    assert {r.text for r in wrapper.extract(named, url_column="host").where("page_id = 1").collect()} == {"x"}


@pytest.mark.parametrize("skeletons, sent", [(16, 8 << 20), (16, 0), (1, 8 << 20)])
def test_rare_layouts_are_told_too(spark, monkeypatch, skeletons, sent):
    """More layouts on a host than trees that its wrapper is merged from: no menu of any of them stays, no article is lost."""
    monkeypatch.setattr(wrapper, "SKELETONS", skeletons)
    monkeypatch.setattr(wrapper, "SENT", sent)
    letters = "abcdefghijklmnopqrst"
    rows = [(i * 20 + k, "http://h.org/x", f"<div class=z{c}><div>Home {c}</div><div class=y>Text {i} of {c}</div><div>Legal {c}</div></div>") for i in range(12) for k, c in enumerate(letters)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i * 20 + k: f"Text {i} of {c}" for i in range(12) for k, c in enumerate(letters)}


def test_nodes_beyond_the_wrapper_are_told_too(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [z + a + b for z in "yz" for a in letters for b in letters]
    assert len(names) > wrapper.NODES
    rows = [(i, "http://h.org/x", "".join(f"<div class=x{n}>Text {i} {n}</div>" for n in names) + "<div class=z>Home</div>") for i in range(12)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(f"Text {i} {n}" for n in names) for i in range(12)}
