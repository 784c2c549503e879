"""Operator 12: the main text of pages by wrapper induction: trees of a host's pages are aligned, what stays the same is template."""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T

from .common import attach, discard, pick, written

#: Elements that begin and end a block; all others are inline and don't part text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is neither markup nor text of the page.
RAW = frozenset("script style title iframe noembed noframes textarea".split())
#: Elements that are no part of an article.
OTHER = frozenset("nav footer aside form head noscript template select dialog menu".split())
#: The same within a block, which they don't part.
MUTE = frozenset("button svg object canvas audio video".split())
#: Words in class, id or role that tell the same.
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising alert banner banners breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies discussion disqus feedback footer gdpr header login masthead menu menus modal nav navbar navi navigation newsletter notice notices notification notifications overlay pager pagination popular popup promo promoted promotion promotions recommendations recommended related replies reply respond search share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar topnav trending widget widgets".split()
)
#: With one of these, a header is the article's own.
OWN_WORDS = frozenset("article content entry main post story title".split())
#: What an element of a name closes if it is open, up to one of the elements after it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}

NEXT = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
NAMED = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

#: Open elements that are kept; deeper ones part text and no more.
DEPTH = 150
#: Nodes of a wrapper; page nodes that find no place in it are told by their paths.
NODES = 1000
#: Skeletons, the commonest of a host, that its wrapper is merged from; what is constant is told by all of its pages.
SKELETONS = 16
#: Pairs of children that are aligned at the highest gain; wider nodes are aligned from the left.
PAIRS = 1 << 18
#: A slot is template if pages with at least so many different contents have it, and its texts are at most this share of them: each comes back with four contents on average.
CONTENTS, SHARE = 8, 0.25
#: Bytes of all hosts' wrappers, or of what pages have beside them, up to which they are broadcast.
SENT = 8 << 20


class Node:
    """An element: signature, parent, children; `run` is the folded node that it belongs to."""

    __slots__ = ("sig", "parent", "children", "run", "number")

    def __init__(self, sig: str, parent: Node | None):
        self.sig, self.parent, self.children, self.run, self.number = sig, parent, [], None, -1
        if parent is not None:
            parent.children.append(self)


class Page:
    """A page's tree of block elements, and its blocks in order: (node, text, characters in links, ruled out, heading, root)."""

    def __init__(self, html: str):
        self.top = Node("", None)
        self.blocks: list[tuple[Node, str, int, bool, bool, int]] = []
        self.roots: list[tuple[str, bool]] = []  # (article or main, with a top heading), those not ruled out
        self._read(html)

    def _read(self, html: str) -> None:
        # An open element: name, node, ruled out by its name, by its words, inside of which root.
        stack: list[list] = [["", self.top, False, False, -1]]
        opened: dict[str, int] = {}
        skipped: dict[str, int] = {}
        pieces: list[str] = []
        linked = links = mute = muted_at = 0
        held: list[tuple] = []

        def end_block() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    held.append((stack[-1], text, linked, any(x[0] == "h1" for x in stack[-2:])))
                pieces.clear()
            linked = 0

        def close(upto: int) -> None:
            nonlocal mute
            for x in stack[upto:]:
                opened[x[0]] -= 1
            del stack[upto:]
            if len(stack) < muted_at:
                mute = 0

        def say(raw: str) -> None:
            nonlocal linked
            if stack[-1][0] == "head" and not raw.isspace():
                close(len(stack) - 1)
            if mute:
                return
            if "&" in raw:
                raw = references.unescape(raw)
            pieces.append(raw)
            if links:
                linked += len(raw)

        at, n = 0, len(html)
        while at < n:
            found = NEXT.search(html, at)
            if found is None:
                say(html[at:])
                break
            start = found.start()
            if start > at:
                say(html[at:start])
            if found.group() == "<!--":
                end = html.find("-->", start + 2)
                at = n if end < 0 else end + 3
                continue
            tag = TAG.match(html, start) if found.group()[-1].isalpha() else None
            if tag is None:  # a declaration or what browsers take for a comment; a tag without an end goes with the rest
                end = html.find(">", start)
                at = n if end < 0 else end + 1
                continue
            at = tag.end()
            name = tag.group(1).lower()
            if html[start + 1] == "/":
                if name == "a":
                    links = max(0, links - 1)
                elif name == "br":
                    pieces.append(" ")
                elif name in MUTE:
                    mute = max(0, mute - 1)
                elif name in BLOCKS:
                    end_block()
                    if skipped.get(name):
                        skipped[name] -= 1
                    elif opened.get(name):
                        close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                continue
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                at = n if end is None else end.start()
                close_tag = TAG.match(html, at) if end is not None else None
                at = close_tag.end() if close_tag else n
                continue
            if name == "a":
                links += 1
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    end_block()
                continue
            if name in MUTE:
                if not mute:
                    muted_at = len(stack)
                mute += not tag.group(2).endswith("/")
                continue
            if name not in BLOCKS:
                continue
            end_block()
            if stack[-1][0] == "p" or stack[-1][0] == "head" and name not in ("noscript", "template"):
                close(len(stack) - 1)
            if name in CLOSES:
                closed, bounds = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        close(k)
                        break
                    if stack[k][0] in bounds:
                        break
            if len(stack) > DEPTH or name in ("html", "body") and opened.get(name):
                if name not in ("html", "body"):
                    skipped[name] = skipped.get(name, 0) + 1
                continue
            stated = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in NAMED.finditer(tag.group(2))} if "=" in tag.group(2) else {}
            worded = {w for v in stated.values() for part in re.split(r"[^0-9A-Za-z]+", v) for w in CAMEL.sub(" ", part).lower().split()} if stated else set()
            root = "main" if name == "main" or stated.get("role", "").lower() == "main" else name if name == "article" else ""
            parent = stack[-1]
            by_name = parent[2] or name in OTHER or name == "header" and parent[4] < 0
            hints = worded & OTHER_WORDS
            by_words = name not in ("html", "body") and root != "main" and bool(hints) and not (hints <= {"header"} and worded & OWN_WORDS)
            sig = " ".join([name, *sorted(re.sub(r"\d+", "#", v) for k in ("class", "id") for v in stated.get(k, "").split())])
            inside = parent[4]
            if root and not by_name and not by_words and not (self.roots and any(x[3] for x in stack)):
                for x in stack:  # words around the first root name a layout, not a part
                    x[3] = False
                if root == "main" or inside < 0 or self.roots[inside][0] == "main":
                    inside = len(self.roots)
                    self.roots.append((root, False))
            if name == "h1" and inside >= 0:
                self.roots[inside] = (self.roots[inside][0], True)
            stack.append([name, Node(sig, parent[1]), by_name, by_words, inside])
            stack[-1].append(parent)
            opened[name] = opened.get(name, 0) + 1
        end_block()
        told: dict[int, bool] = {}

        def out(x: list) -> bool:
            """Whether an element or one around it is ruled out, now that all words are judged."""
            path = []
            while len(x) > 5 and id(x) not in told:
                path.append(x)
                x = x[5]
            gone = told.get(id(x), False)
            for x in reversed(path):
                gone = told[id(x)] = gone or x[2] or x[3]
            return gone

        self.blocks = [(x[1], text, links, out(x), top, x[4]) for x, text, links, top in held]


def fold(top: Node) -> Node:
    """The tree with neighbours of one signature folded into one node, which gets the children of all."""
    made = Node(top.sig, None)
    top.run = made
    work = [(made, [top])]
    while work:
        into, members = work.pop()
        last = None
        groups = []
        for child in (c for m in members for c in m.children):
            if last is None or last.sig != child.sig:
                last = Node(child.sig, into)
                groups.append((last, []))
            child.run = last
            groups[-1][1].append(child)
        work += groups
    return made


def in_order(top: Node) -> list[Node]:
    out, work = [], [top]
    while work:
        node = work.pop()
        out.append(node)
        work += reversed(node.children)
    return out


def write_tree(top: Node, most: int = NODES) -> str:
    """[signature, number of the parent] of each node in order; of more than `most` the first ones."""
    nodes = in_order(top)[:most]
    for k, node in enumerate(nodes):
        node.number = k
    return json.dumps([[x.sig, x.parent.number if x.parent else -1] for x in nodes], ensure_ascii=False, separators=(",", ":"))


def read_tree(told: str) -> Node:
    nodes: list[Node] = []
    for k, (sig, parent) in enumerate(json.loads(told)):
        nodes.append(Node(sig, nodes[parent] if parent >= 0 else None))
        nodes[-1].number = k
    return nodes[0]


class Matching:
    """Simple tree matching: the most nodes of two trees that go together with roots, parents and order kept."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def pairs(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        """(size of the matching of two nodes of one signature, the children that go together)."""
        if (known := self.known.get((id(a), id(b)))) is not None:
            return known
        if not a.children or not b.children:
            told = 1, []
        elif len(a.children) == len(b.children) and all(x.sig == y.sig for x, y in zip(a.children, b.children)) and len({x.sig for x in a.children}) == len(a.children):
            told = 1 + sum(self.pairs(x, y)[0] for x, y in zip(a.children, b.children)), [(i, i) for i in range(len(a.children))]
        else:
            told = self._aligned(a, b)
        self.known[id(a), id(b)] = told
        return told

    def _aligned(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        places: dict[str, list[int]] = {}
        for j, y in enumerate(b.children):
            places.setdefault(y.sig, []).append(j)
        rows = [i for i, x in enumerate(a.children) if x.sig in places]
        if len(rows) * len(b.children) > PAIRS:
            out, at, size = [], 0, 1
            for i in rows:
                later = places[a.children[i].sig]
                if (k := bisect_left(later, at)) < len(later):
                    j = later[k]
                    out.append((i, j))
                    size += self.pairs(a.children[i], b.children[j])[0]
                    at = j + 1
            return size, out
        width = len(b.children)
        most = np.zeros((len(rows) + 1, width + 1), np.int64)
        gains = {}
        for r, i in enumerate(rows):
            take = most[r].copy()
            for j in places[a.children[i].sig]:
                gains[r, j] = self.pairs(a.children[i], b.children[j])[0]
                take[j + 1] = max(take[j + 1], most[r, j] + gains[r, j])
            most[r + 1] = np.maximum.accumulate(take)
        out, r, j = [], len(rows), width
        while r and j:
            if most[r, j] == most[r, j - 1]:
                j -= 1
            elif most[r, j] == most[r - 1, j]:
                r -= 1
            else:
                out.append((rows[r - 1], j - 1))
                r, j = r - 1, j - 1
        return 1 + int(most[-1, -1]), out[::-1]


def align(page: Node, wrapper: Node) -> None:
    """Gives each page node the number of its node in the wrapper, -1 to those without."""
    for node in in_order(page):
        node.number = -1
    matching, work = Matching(), [(page, wrapper)]
    while work:
        a, b = work.pop()
        a.number = b.number
        work += [(a.children[i], b.children[j]) for i, j in matching.pairs(a, b)[1]]


def merged(wrapper: Node, page: Node) -> None:
    """Puts the page's nodes that the wrapper lacks into it, after the neighbour before them."""
    matching, work = Matching(), [(wrapper, page)]
    size = len(in_order(wrapper))
    while work:
        a, b = work.pop()
        partner = dict((j, i) for i, j in matching.pairs(a, b)[1])
        children, at, new = list(a.children), 0, []
        for j, y in enumerate(b.children):
            if j in partner:
                upto = partner[j] + 1
                new += children[at:upto]
                at = upto
                work.append((children[partner[j]], y))
            elif size < NODES:
                if (added := len(in_order(y))) <= NODES - size:
                    size += added
                    y.parent = a
                    new.append(y)
        a.children = new + children[at:]


def induced(skeletons: list[str]) -> str:
    """The wrapper of a host: its skeletons merged, the commonest first."""
    top = read_tree(skeletons[0])
    for told in skeletons[1:]:
        merged(top, read_tree(told))
    return write_tree(top)


@lru_cache(maxsize=256)
def wrapper_of(told: str) -> Node:
    return read_tree(told)


def number_rest(page: Page) -> None:
    """Numbers below -1 for nodes with text that found no place in the wrapper: hashes of their paths, of signatures and places among siblings of one signature."""
    known: dict[int, bytes] = {}
    places: dict[int, int] = {}
    for node in {id(x[0].run): x[0].run for x in page.blocks if x[0].run.number < 0}.values():
        path, at = [], node
        while at is not None and id(at) not in known:
            path.append(at)
            at = at.parent
        told = known[id(at)] if at is not None else b""
        for x in reversed(path):
            if x.parent is not None and id(x) not in places:
                seen: dict[str, int] = {}
                for y in x.parent.children:
                    places[id(y)] = seen[y.sig] = seen.get(y.sig, -1) + 1
            told = known[id(x)] = hashlib.blake2b(b"%b %d %b" % (told, places.get(id(x), 0), x.sig.encode("utf-8", "surrogatepass")), digest_size=8).digest()
        node.number = -2 - (int.from_bytes(told, "little") >> 2)


def digest(texts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_blocks(page: Page) -> list[tuple[Node, str, int, bool]]:
    """The blocks (node, text, characters in links, heading) that names and words leave.

    With an article only its blocks; with several, the only one that has a top heading,
    else all of them; of `main` around one article its top headings too.
    """
    left = [x for x in page.blocks if not x[3]]
    articles = [k for k, (kind, _) in enumerate(page.roots) if kind == "article"]
    if not page.roots:
        return [(x[0], x[1], x[2], x[4]) for x in left]
    if len(articles) > 1 and len(headed := [k for k in articles if page.roots[k][1]]) == 1:
        articles = headed
    held = set(articles) if articles else set(range(len(page.roots)))
    kept = [(x[0], x[1], x[2], x[4]) for x in left if x[5] in held or x[5] >= 0 and x[4]]
    return kept or [(x[0], x[1], x[2], x[4]) for x in left]


def slots(page: Page, wrapper: str | None) -> dict[int, list[str]]:
    """The texts at each place of the wrapper, and at each path beside it."""
    top = fold(page.top)
    out: dict[int, list[str]] = {}
    if wrapper:
        align(top, wrapper_of(wrapper))
        number_rest(page)
        for node, text, *_ in page.blocks:
            out.setdefault(node.run.number, []).append(text)
    return out


def main_text(page: Page, wrapper: str | None, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, a line each."""
    slots(page, wrapper)
    kept = main_blocks(page)
    rooted = bool(page.roots)
    if wrapper:
        kept = [x for x in kept if x[0].run.number not in template or x[3] and rooted]
    if not rooted:  # a menu that nothing names: three or more blocks in a row that are links
        counts: dict[int, list[int]] = {}
        for node, text, links, _ in kept:
            told = counts.setdefault(id(node.run), [0, 0, 0])
            told[0] += 1
            told[1] += len(text)
            told[2] += links
        kept = [x for x in kept if not ((c := counts[id(x[0].run)])[0] >= 3 and c[2] >= 0.9 * c[1])]
    return "\n".join(x[1] for x in kept)


def wrappers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (host, html): (host, wrapper, template, pages) of each host, its merged tree and the numbers of its constant nodes; and
    (host, page, rest) of the pages, by the hash of their html, that have constant places beside the wrapper: their numbers.

    A host may have any number of such places, so each page gets its own only.
    """
    skeleton = T.StructType([T.StructField("host", T.StringType()), T.StructField("skeleton", T.StringType())])

    def skeletons(batches):
        for batch in batches:
            told = [write_tree(fold(Page(v.as_py() or "").top)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], skeleton.names)

    counts = rows.select("host", "html").mapInArrow(skeletons, skeleton).groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts)
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "skeleton"))
    few = counts.withColumn("place", place).where(F.col("place") <= SKELETONS).select("host", "place", "skeleton")

    def merge(table: pa.Table) -> pa.Table:
        in_place = table.sort_by("place")
        return pa.table({"host": in_place.column("host").slice(0, 1), "wrapper": pa.array([induced(in_place.column("skeleton").to_pylist())], pa.string())})

    made = few.groupBy("host").applyInArrow(merge, "host string, wrapper string").join(counts.groupBy("host").agg(F.sum("n").alias("pages")), "host")
    made = written(made)
    discard(counts)
    seen = T.StructType([T.StructField("host", T.StringType()), T.StructField("node", T.LongType()), T.StructField("text", T.LongType()), T.StructField("content", T.LongType()), T.StructField("page", T.LongType())])

    def stated(batches):
        for batch in batches:
            hosts, nodes, texts, contents, pages = [], [], [], [], []
            for host, value, wrapper, hashed in zip(*(batch.column(k) for k in range(4))):
                page = Page(value.as_py() or "")
                found = slots(page, wrapper.as_py())
                content = digest([x[1] for x in main_blocks(page)])
                for node, own in found.items():
                    hosts.append(host.as_py())
                    nodes.append(node)
                    texts.append(digest(own))
                    contents.append(content)
                    pages.append(hashed.as_py() if node < 0 else None)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (nodes, texts, contents, pages))], seen.names)

    found = written(joined(rows, made).select("host", "html", "wrapper", F.xxhash64("html").alias("page")).mapInArrow(stated, seen))
    met = found.groupBy("host", "node", "text", "content").agg(F.count(F.lit(1)).alias("n"))
    by_text = met.groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("contents"))
    by_node = by_text.groupBy("host", "node").agg(F.count(F.lit(1)).alias("texts"), F.sum("contents").alias("contents"))
    constant = written(by_node.where((F.col("contents") >= CONTENTS) & (F.col("texts") <= F.greatest(F.lit(1.0), F.col("contents") * SHARE))).select("host", "node"))
    # A host's list holds numbers of its wrapper's nodes, NODES at most.
    out = written(made.join(constant.where("node >= 0").groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("template")), "host", "left"))
    # Two pages of one hash get both pages' places, which are constant on their host all the same.
    rest = written(found.where("page is not null").join(constant.where("node < 0"), ["host", "node"]).groupBy("host", "page").agg(F.array_sort(F.collect_set("node")).alias("rest")))
    for table in (made, found, constant):
        discard(table)
    return out, rest


def joined(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with their host's facts: broadcast as far as SENT bytes, else joined with the pages of hot hosts dealt out."""
    size = facts.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    if size <= SENT:
        return rows.join(F.broadcast(facts.drop("pages")), "host", "left")
    return attach(rows, facts, "host", "pages")


def with_rest(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """rows with their pages' constant places beside the wrapper."""
    size = rest.agg(F.sum(8 * F.size("rest") + F.octet_length("host") + 8)).first()[0] or 0
    if not size:
        return rows.withColumn("rest", F.lit(None).cast("array<long>"))
    return rows.withColumn("page", F.xxhash64("html")).join(F.broadcast(rest) if size <= SENT else rest, ["host", "page"], "left")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page: its main text, blocks a line each, from the whole html.

    Pages of a host are aligned with the host's wrapper by simple tree matching, whose
    nodes are block elements, neighbours of one signature folded into one. The wrapper is
    merged from the host's SKELETONS commonest trees; which of its nodes are constant is
    told by all pages: a node is template if pages of at least CONTENTS different main
    texts have it and its own texts are few beside them (SHARE: menus may come in some
    variants; copies of one article count as one, so they don't look constant). Nodes
    that have no place in the wrapper, as those of rarer trees or beyond its NODES, are told in the
    same way, by all pages that have a node at the same path. Template goes; so do elements that names (nav,
    footer, form, ...) or words of class, id or role (comments, cookie notice, advert,
    ...) rule out, for what varies from page to page needn't be the article; and if there
    is an `article` or `main`, what lies outside of it. A host with few pages is left to
    names and words. Character references are decoded, any Unicode white space within a
    block becomes one space; br is white space, inline elements part nothing.

    Null html counts as empty, its text is empty. Pages whose url is null or names no host
    have no wrapper. Null and repeated ids are kept row by row; an empty table gives no
    rows; other columns are left out. Markup is read in linear time: a tag or quote that
    is never closed, 10^5 open elements or children do not change that.
    """
    rows = pick(pages, id_column, url_column, html_column)
    rows = rows.select(F.col(id_column).alias("_id"), F.col(url_column).alias("_url"), F.col(html_column).alias("html"), F.nullif(F.lower(F.regexp_extract(F.col(url_column), HOST, 1)), F.lit("")).alias("host"))
    facts, rest = wrappers(rows.where(F.col("host").isNotNull()).select("host", "html"))
    chosen = with_rest(joined(rows, facts), rest).select("_id", "_url", "html", "wrapper", "template", "rest")
    schema = T.StructType([chosen.schema["_id"], chosen.schema["_url"], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = []
            for value, wrapper, template, own in zip(*(batch.column(k) for k in (2, 3, 4, 5))):
                texts.append(main_text(Page(value.as_py() or ""), wrapper.as_py(), frozenset((template.as_py() or []) + (own.as_py() or []))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema.names)

    out = chosen.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(F.col("_id").alias(id_column), F.col("_url").alias(url_column), "text", "n_chars")
