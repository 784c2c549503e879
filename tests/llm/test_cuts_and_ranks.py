"""Operators 11 and 13 against plain versions, with awkward rows."""

import collections
import hashlib
import heapq
import math
import random
import re

import numpy as np
import pytest

from cladewise.llm import middle, queries, ranked

from .test_operators import SF, rows_of

# 11


def plain_cut(text, units):
    if units == "code_points":
        return list(text)
    return re.findall(r"\s*\S+\s*|\s+" if units == "words" else r"[^\n]*\n|[^\n]+", text, re.ASCII)


@pytest.mark.parametrize("units", ["code_points", "words", "lines"])
def test_cut_is_that_of_a_plain_split(units):
    rng = random.Random(5)
    for k in range(600):
        text = "".join(rng.choices("ab é\n\t 漢😀", k=rng.randrange(0, 60)))
        parts = plain_cut(text, units)
        ranks = (rng.randrange(1 << 32), rng.randrange(1 << 32))
        n, before, within, a, b = middle.cut(text.encode(), units, ranks)
        assert n == len(parts)
        x, y = sorted(r % (n + 1) for r in ranks)
        assert (before, within) == (x, y - x)
        if n:
            assert text.encode()[:a].decode() == "".join(parts[:x]) and text.encode()[a:b].decode() == "".join(parts[x:y])


def test_select_finds_every_marked_bit():
    rng = random.Random(6)
    for width in (1, 2, 3, 7, 64, 1001):
        marks = rng.getrandbits(width)
        places = [i for i in range(width) if marks >> (width - 1 - i) & 1]
        assert middle.select(marks, width, [*range(len(places))]) == dict(enumerate(places))


def plain_middle(own, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if own is None else own}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle_awkward(spark):
    texts = [None, "", "a", "é", "<P", "a<S>b", "x<", "<<>S>P>M>", "漢字😀" * 50, "w " * 200_000, "\n\r\x00\t", "same", "same"]
    rows = [(i, t, "own", "other") for i, t in enumerate(texts * 6)] + [(None, "no id", "", ""), (3, "again", "", ""), (3, "again", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, TEXT string")
    out = middle.fill_in_middle(docs).collect()
    want = collections.Counter((r[0], *plain_middle(r[0], r[1])) for r in rows)
    assert collections.Counter(tuple(r) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    told = collections.Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in middle.report(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert told == collections.Counter((r[0], sha(plain_middle(r[0], r[1])[4]), sha(r[1] or "")) for r in rows)
    assert middle.fill_in_middle(docs.where("false")).collect() == []
    for bad in ({"units": "pages"}, {"marks": ("<a>", "<a>", "<b>")}, {"marks": ("a", "b", "c")}):
        with pytest.raises(ValueError):
            middle.fill_in_middle(docs, **bad)


def test_middle_of_words_and_lines_comes_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for units in ("words", "lines"):
        rows = middle.fill_in_middle(docs, units=units, plain=0, spm=50)
        texts = {r.doc_id: r.text for r in docs.collect()}
        got = rows.select("doc_id", middle.restored(rows.output, rows.form).alias("text")).collect()
        assert {r.doc_id: r.text for r in got} == texts


# 13


def plain_rank(docs, items, most=50):
    split = lambda t: [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counted = [(i, c) for i, t in docs if (c := collections.Counter(split(t)))]
    N, L = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for own, c in counted:
            m = 50 + 50 * sum(c.values()) * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(split(text)) if w in c)
            if score > 0:
                scores.append((-score, own is None, own or 0))
        out += [(item, k + 1, None if none else own, -s) for k, (s, none, own) in enumerate(sorted(scores)[:most])]
    return collections.Counter(out)


LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("run", [1, 60, 1 << 20])
def test_ranks_are_those_of_all_scores(spark, run):
    rng = random.Random(8)
    vocabulary = ["alpha", "Beta", "γάμμα", "É", "d3", "x_y", "common", "a\x00b", "B\xa0b"]
    text = lambda: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, [1, 2, 3, 4, 5, 6, 40, 1, 1], k=rng.randrange(0, 40)))
    docs = [(i, text()) for i in range(150)] + [(None, "beta alpha"), (7, "Beta"), (7, "Beta"), (200, None), (201, "..."), (202, "alpha " * 5000)] + [(300 + i, "d3 common") for i in range(80)]
    items = [(i, text()) for i in range(12)] + [(3, "alpha"), (None, "beta"), (50, None), (51, ""), (52, "absent"), (53, "common"), (53, "common")]
    frame = spark.createDataFrame([(*d, "", 0) for d in docs], "doc_id long, text string, TEXT string, row int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.search(frame, asked, most=20, run=run)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_rank(docs, items, 20)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_ranks_by_blocks_of_items_and_empty_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = collections.Counter(tuple(r) for r in ranked.search(docs, items).collect())
    assert whole == collections.Counter(tuple(r) for r in ranked.search(docs, items, block=300, run=500).collect())
    assert whole == plain_rank([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for a, b in ((docs.where("false"), items), (docs, items.where("false"))):
        out = ranked.search(a, b)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError):
        ranked.search(docs, items, most=0)


def test_bounds_leave_ranges_closed():
    """Best-first order opens ranges only as long as they can hold one of the best, and all that tie with the last."""
    rng = np.random.default_rng(1)
    n = 1 << 14
    rare, common = rng.choice(n, 40, replace=False), np.arange(n)
    terms = np.r_[np.zeros(len(rare), int), np.ones(n, int)]
    docs = np.r_[rare, common]
    values = np.r_[rng.integers(800_000, 900_000, len(rare)), np.full(n, 400_000)]
    trees, opened, push = ranked.MaxTrees(n, terms, docs, values), [0], heapq.heappush
    found = trees.search({0: 9000, 1: 3}, 10)
    scores = np.zeros(n, np.int64)
    np.add.at(scores, docs, np.where(terms == 0, 9000, 3) * values)
    assert found == [(int(scores[d]), int(d)) for d in np.lexsort((np.arange(n), -scores))[:10]]
    ranked.heapq.heappush = lambda *a: (opened.__setitem__(0, opened[0] + 1), push(*a))
    try:
        trees.search({0: 9000, 1: 3}, 10)
    finally:
        ranked.heapq.heappush = push
    assert opened[0] < n // 4
    tied = ranked.MaxTrees(n, np.zeros(n, int), np.arange(n), np.full(n, 7)).search({0: 5}, 100)
    assert tied == [(35, d) for d in range(100)]


def test_queries_are_there():
    assert {"op11_fill_in_middle", "op13_ranked_search"} <= set(queries.queries())
