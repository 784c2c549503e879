"""Near-duplicates of short texts: none at the threshold is missed; the row that stays of an id is the same each time."""

import itertools
import random

import numpy as np
import pytest

from cladewise.llm import simhash


def texts(seed, pairs):
    """Pairs at Jaccard 4/5 and 8/10 exactly, and just below at 4/6 and 7/10; all others far apart."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    out = []
    for _ in range(pairs):
        a = [word() for _ in range(8)]
        b = [word() for _ in range(13)]
        c = [word() for _ in range(29)]
        out += [a, [*a, word()], [*a, word(), word()], b, [*b[:12], word()], [*b[:11], word(), word()], c, [*c, *(word() for _ in range(6))]]
    return [" ".join(x) for x in out]


def brute(held, least=0.8):
    sets = [frozenset(simhash.shingle_hashes(x, 5).tolist()) for x in held]
    by, root = {}, list(range(len(held)))
    for i, s in enumerate(sets):
        for h in s:
            by.setdefault(h, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for pair in {p for ids in by.values() for p in itertools.combinations(ids, 2)}:
        a, b = (sets[i] for i in pair)
        if len(a & b) >= least * len(a | b) - 1e-9:
            low, high = sorted(map(top, pair))
            root[high] = low
    return {i: top(i) for i in range(len(held))}


def test_no_short_pair_is_missed(spark):
    held = texts(3, 150)
    want = brute(held)
    assert len(held) - len(set(want.values())) >= 450  # three links a round
    frame = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()} == want


@pytest.mark.parametrize("block", [4, 1024])
def test_hot_shingles(spark, monkeypatch, block):
    """Many short texts with one passage, some of them near copies; buckets of more than a block are split."""
    monkeypatch.setattr(simhash, "SETS", block)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(12))
    own = [" ".join([passage, *(f"t{i // 3}x{k}" for k in range(10 + i % 3))]) for i in range(60)]
    held = [*own, *(f"{passage} e{i}" for i in range(30)), passage]
    rng.shuffle(held)
    frame = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()} == brute(held)


def test_rare_roots_join_every_pair(spark):
    rng = np.random.RandomState(1)
    sets = [np.unique(rng.choice(40, rng.randint(1, 32), replace=False)).astype("<u8") for _ in range(300)]
    sets += [np.setdiff1d(s, s[:1]) for s in sets if len(s) >= 5]
    frame = spark.createDataFrame([(i.to_bytes(4, "big"), s.tobytes()) for i, s in enumerate(sets)] + [(b"none", None)], "digest binary, few binary")
    met = {}
    for r in simhash.rare_roots(frame, 0.8).collect():
        met.setdefault(int.from_bytes(r.digest, "big"), set()).add(bytes(r.root))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            assert met.get(i, set()) & met.get(j, set())


def test_row_of_an_id_is_the_same_each_time(spark):
    rows = [(1, f"text number {i} with words enough to be a text of its own", None if i % 2 else i, {"k": i}) for i in range(40)] + [(2, None, 1, None), (2, "", 1, {"a": 1})]
    seen = set()
    for parts in (1, 3, 7):
        frame = spark.createDataFrame(rows, "doc_id long, text string, extra int, m map<string,int>").repartition(parts)
        kept = simhash.one_of_each(frame)
        assert kept.columns == frame.columns
        found = sorted((r.doc_id, r.text or "", r.extra) for r in kept.collect())
        assert [x[0] for x in found] == [1, 2]
        seen.add(str(found))
    assert len(seen) == 1
