"""Operator 5: near-duplicates by SimHash, compared bit plane by bit plane."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import attach, checkpointed, discard, pick, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fingerprints of a hot bucket that are compared with another so many at a time.
BLOCK = 2048
#: Buckets are split if they hold more than BLOCK rows and more than 1/MOST_SPLIT of them all: MOST_SPLIT at most.
MOST_SPLIT = 20_000
#: (fingerprint, word) pairs compared together, and shingles whose bits are unpacked together.
PAIRS, SHINGLES = 1 << 16, 1 << 15
#: Shingle sets that are compared together, and bits that tell which sets are wanted.
SETS, SIEVE = 1024, 1 << 23
#: Pairs whose smaller set has so many shingles at most are all found, by their rarest shingles.
SHORT = 25
#: The share of bits in which two sets at Jaccard 0.8 differ on average, and the chance at which tables may miss such a pair.
EXPECTED, MISSED = 78 / 512, 0.001
#: Rows of a bucket on average at most, slices that are joined to one key at most, and places that a table of longer fingerprints samples.
BUCKET, MOST_SLICES, PLACES = 512, 4, 12


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words of the text in lower case (A-Z only), repeats included; of all words if they are fewer."""
    import xxhash

    found = WORD.findall(text.encode().translate(LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(begin[: len(found) - words + 1].tolist(), end[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """bits/64 words; bit k of word 0 is set if more than half of the hashes have it.

    Further words come from the hashes mixed anew (the finaliser of splitmix64).
    """
    out = np.zeros(bits // 64, np.uint64)
    for w in range(bits // 64 if len(hashes) else 0):
        if w:
            x = hashes + np.uint64((0x9E3779B97F4A7C15 * w) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        else:
            x = hashes
        ones = np.zeros(64, np.int64)
        for i in range(0, len(x), SHINGLES):
            planes = np.unpackbits(x[i : i + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += planes.sum(0, dtype=np.int32)
        out[w] = np.packbits((2 * ones > len(x)).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out


def tables(bits: int, radius: int, rows: int) -> list[list[int]]:
    """The bit places of each candidate table: two fingerprints in one bucket of any table are compared.

    64 bits are cut into radius + m slices, and each choice of m slices is a table. Two
    fingerprints that differ in at most radius bits are equal in m slices at least, so
    no pair is missed, whatever m is; m grows until `rows` fingerprints fill buckets of
    at most BUCKET on average, which keeps the comparisons in proportion to the rows.

    For longer fingerprints a table samples PLACES places; there are so many tables
    that a pair at the distance expected of Jaccard 0.8 (EXPECTED of the bits) is in no
    bucket together with a chance of MISSED. They don't depend on the rows.
    """
    if bits == 64:
        for m in range(1, MOST_SLICES + 1):
            edges = [round(i * bits / (radius + m)) for i in range(radius + m + 1)]
            slices = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
            if rows <= BUCKET << (m * bits // (radius + m)):
                break
        return [sum(chosen, []) for chosen in itertools.combinations(slices, m)]
    equal = (1 - EXPECTED) ** PLACES
    number = math.ceil(math.log(MISSED) / math.log(1 - equal))
    order = np.random.RandomState(SEED)
    return [sorted(order.choice(bits, PLACES, replace=False).tolist()) for _ in range(number)]


def within(planes: np.ndarray, prints: np.ndarray, left: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a fingerprint and a word of 64 others: the words' masks of those within radius, and which pairs are left.

    planes[k, w] holds bit k of the 64 fingerprints of word w. Three planes at a time
    go through a carry-save adder into vertical counters that start at 2^n - 1 - radius:
    the carry out of their top bit marks what exceeds the radius. After every twelve
    planes, pairs all of whose 64 lanes are marked are dropped.
    """
    bits = len(planes)
    n = max(2, radius.bit_length())
    start = (1 << n) - 1 - radius
    alive = np.arange(len(left))
    over = np.zeros(len(left), np.uint64)
    counters = [np.full(len(left), ALL if start >> i & 1 else np.uint64(0), np.uint64) for i in range(n)]

    def differing(k: int) -> np.ndarray:
        if k >= bits:
            return np.zeros(len(left), np.uint64)
        own = (prints[left, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)
        return planes[k, word] ^ (np.uint64(0) - own)

    def add(carry: np.ndarray, at: int) -> np.ndarray:
        for i in range(at, n):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        return carry

    for k in range(0, bits, 3):
        a, b, c = differing(k), differing(k + 1), differing(k + 2)
        ab = a ^ b
        over |= add(ab ^ c, 0)
        over |= add((a & b) | (ab & c), 1)
        if k % 12 == 9 and k + 3 < bits:
            some = over != ALL
            if not some.all():
                alive, left, word, over = alive[some], left[some], word[some], over[some]
                counters = [x[some] for x in counters]
                if not len(alive):
                    break
    return ~over, alive


def links(prints: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Edges (i, j) that join the fingerprints of each bucket as all their links within radius would.

    Rows are sorted by bucket. side: 0 in a bucket that is compared with itself; in a
    pair of blocks, 1 for its left and 2 for its right block.
    """
    size = len(prints)
    first = np.r_[True, bucket[1:] != bucket[:-1]]
    begin = np.flatnonzero(first)
    length = np.diff(np.r_[begin, size])
    words = -(-length // 64)
    base = np.cumsum(words) - words
    group = np.cumsum(first) - 1
    lane = np.arange(size) - begin[group]
    word_of, bit_of = base[group] + lane // 64, lane % 64
    planes = np.zeros((prints.shape[1] * 64, int(words.sum())), np.uint64)
    for k in range(len(planes)):
        own = (prints[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)
        np.bitwise_or.at(planes[k], word_of, own << bit_of.astype(np.uint64))
    number = words[group] - lane // 64  # words from a row's own on
    root = np.arange(size)
    upto = np.cumsum(number)
    at = 0
    while at < size:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = number[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        word = word_of[left] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near, alive = within(planes, prints, left, word, radius)
        left, word = left[alive], word[alive]
        hit = np.flatnonzero(near)
        near, left, word = near[hit], left[hit], word[hit]
        for k in range(0, len(hit), PAIRS // 8):
            part = slice(k, k + PAIRS // 8)
            lanes = np.unpackbits(near[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, b = np.nonzero(lanes)
            i = left[part][r]
            j = begin[group[i]] + (word[part][r] - base[group[i]]) * 64 + b
            good = (j < begin[group[i]] + length[group[i]]) & (j > i)
            i, j = i[good], j[good]
            across = (side[i] == 0) | (side[i] != side[j])
            root = joined(root, i[across], j[across])
        at = stop
    to = np.flatnonzero(root != np.arange(size))
    return np.stack([root[to], to], 1)


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (least members) after the links i-j, each root pointing to itself."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j = i[open_], j[open_]
        low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def batched(batches: Iterator[pa.RecordBatch], keys: int, most: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of some rows each; rows with equal first `keys` columns, which come together, stay together."""
    waiting: list[pa.RecordBatch] = []
    count = 0

    def tail(t: pa.Table) -> int:
        """Where the last key begins."""
        changed = np.zeros(t.num_rows, bool)
        for k in range(keys):
            x = t.column(k).to_numpy()
            changed[1:] |= x[1:] != x[:-1]
        where = np.flatnonzero(changed)
        return int(where[-1]) if len(where) else 0

    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count >= most:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            if cut := tail(whole):
                yield whole.slice(0, cut)
            rest = whole.slice(cut)
            waiting, count = rest.to_batches(), rest.num_rows if cut else 0
    if waiting and (whole := pa.Table.from_batches(waiting).combine_chunks()).num_rows:
        yield whole


def fingerprints(docs: DataFrame, words: int, bits: int, id_column: str = "doc_id") -> DataFrame:
    """(id, print: binary, bits/8 bytes) of each row, its whole text read."""
    rows = pick(docs, id_column, "text")
    schema = T.StructType([rows.schema[0], T.StructField("print", T.BinaryType())])

    def run(batches):
        for batch in batches:
            out = [fingerprint(shingle_hashes(x.as_py() or "", words), bits).astype(">u8").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def link_prints(prints: DataFrame, bits: int, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column print) that keep all of their links' components.

    Buckets of all tables are dealt by hash. The few that may be too large for a task
    are split into blocks of BLOCK, and each pair of blocks is a bucket of its own.
    """
    total = prints.count()
    places = tables(bits, radius, total)
    slots = len(places)

    def keys(batches):
        for batch in batches:
            raw = batch.column(0)
            words = np.frombuffer(b"".join(raw.to_pylist()), ">u8").astype(np.uint64).reshape(-1, bits // 64)
            for t, chosen in enumerate(places):
                key = np.zeros(len(words), np.int64)
                for at, k in enumerate(chosen):
                    key |= ((words[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)).astype(np.int64) << at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), raw], ["slot", "key", "print"])

    rows = prints.mapInArrow(keys, "slot int, key long, print binary")
    most = max(BLOCK, math.ceil(slots * total / MOST_SPLIT))
    counts = rows.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = checkpointed(counts.where(F.col("n") > most).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    rows = rows.join(F.broadcast(hot), ["slot", "key"], "left")
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, block).alias("low"), F.greatest(o, block).alias("high"), F.when(o == block, 0).when(block < o, 1).otherwise(2).alias("side")))
    )
    rows = rows.select("slot", "key", "print", F.explode(pairs).alias("p")).select("slot", "key", "p.low", "p.high", "p.side", "print")
    # Sorted by print as well: the least one of a bucket is where its edges meet, the same in all tables.
    rows = rows.repartition("slot", "key", "low", "high").sortWithinPartitions("slot", "key", "low", "high", "print")

    def compare(batches):
        for table in batched(batches, 4):
            raw = table.column("print").combine_chunks()
            words = np.frombuffer(b"".join(raw.to_pylist()), ">u8").astype(np.uint64).reshape(-1, bits // 64)
            parts = [table.column(c).to_numpy() for c in ("slot", "key", "low", "high")]
            changed = np.zeros(len(words), bool)
            for x in parts:
                changed[1:] |= x[1:] != x[:-1]
            found = links(words, np.cumsum(changed), table.column("side").to_numpy(), radius)
            if len(found):
                yield pa.RecordBatch.from_arrays([raw.take(pa.array(found[:, 0])), raw.take(pa.array(found[:, 1]))], ["a", "b"])

    return rows.mapInArrow(compare, "a binary, b binary").distinct()


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, by turns of large-star and small-star.

    Each turn joins the edges with each node's least neighbour, a partial sum by node;
    attach() keeps the edges of a node with many from meeting in one task. Each step is
    written to the checkpoint folder, so plans and lineage stay short. It ends when
    every component is a star: that is, when each node with a smaller neighbour has no
    other one.
    """
    pairs = written(edges.select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v")).where("u <> v").distinct())
    while True:
        ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = pairs.select(ends.alias("e")).groupBy("e.u").agg(F.min("e.v").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("e.v") < F.col("e.u")).alias("smaller"))
        least = written(least)
        if least.where("smaller > 0 and n > 1").isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large-star: what is larger than a node goes to the least of the node and its neighbours
        centre = least.select(F.col("u").alias("v"), F.least("u", "m").alias("m"), (F.col("n") - F.col("smaller")).alias("n"))
        large = written(attach(pairs, centre, "v", "n").select("u", F.col("m").alias("v")).distinct())
        # small-star: what is smaller than a node, and the node, go to the least of them
        centre = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        met = attach(large, centre, "u", "n").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = written(met.where("u <> v").distinct())
        for done in (pairs, least, large):
            discard(done)
        pairs = after


def groups(docs: DataFrame, words: int = 4, bits: int = 64, radius: int = 4, id_column: str = "doc_id") -> DataFrame:
    """(id, print, component_id) of each row: component_id is the least id that links lead to, its own included.

    Equal fingerprints are one node, so copies cost nothing but their own row. Null
    texts count as empty; texts without words have fingerprint zero and link like any
    other. Rows with a null id get their fingerprint's component (null if no row there
    has an id); repeated rows are kept; an empty table gives no rows; other columns
    are left out.
    """
    rows = checkpointed(fingerprints(docs, words, bits, id_column))
    nodes = rows.groupBy("print").agg(F.min(id_column).alias("_least"), F.count(F.lit(1)).alias("_n"))
    nodes = checkpointed(nodes)
    found = components(link_prints(nodes.select("print"), bits, radius))
    rooted = nodes.join(found, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_prints"))
    named = attach(rooted.select("root", "print", "_n"), least, "root", "_prints").drop("root")
    return attach(rows, named, "print", "_n").select(id_column, "print", "component_id")


def shown(prints: DataFrame) -> DataFrame:
    """The fingerprint as lower-case hexadecimal digits."""
    return prints.withColumn("fingerprint", F.lower(F.hex("print"))).drop("print")


def set_rows(docs: DataFrame, words: int, bits: int, most: int = 0) -> DataFrame:
    """(doc_id, print, digest, few) of each row: print of its distinct shingles, each once, 16 bytes that tell their set, and the set itself if it has `most` at most."""
    rows = pick(docs, "doc_id", "text")
    schema = T.StructType([rows.schema[0], *(T.StructField(c, T.BinaryType()) for c in ("print", "digest", "few"))])

    def run(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(x.as_py() or "", words)) for x in batch.column(1)]
            out = [pa.array([fingerprint(x, bits).astype(">u8").tobytes() for x in found], pa.binary()), pa.array([digest(x) for x in found], pa.binary()), pa.array([x.astype("<u8").tobytes() if 0 < len(x) <= most else None for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], schema.names)

    return rows.mapInArrow(run, schema)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()


def rare_roots(sets: DataFrame, least: float) -> DataFrame:
    """(root, digest) of the sets (digest, few): root is each of their rarest shingles that another set has too, enough of them that no pair is missed.

    Of n shingles, two sets at `least` share least * n, so the n - least * n + 1 that come
    first in one order of all shingles can't all be without the other's. The order is by
    how many sets have a shingle, so buckets stay as small as they can.
    """
    few = sets.where("few is not null").select("digest", "few", (F.octet_length("few") / 8).cast("int").alias("size"))
    each = few.select("digest", "size", F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.substring(F.col("few"), i * 8 + 1, F.lit(8)))).alias("root"))
    number = each.groupBy("root").agg(F.count(F.lit(1)).alias("number")).withColumn("_n", F.col("number"))
    ranked = attach(each, number, "root", "_n").groupBy("digest", "size").agg(F.sort_array(F.collect_list(F.struct("number", "root"))).alias("ranked"))
    first = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9).cast("int") + 1
    return ranked.select("digest", F.explode(F.slice("ranked", F.lit(1), first)).alias("r")).where("r.number > 1").select(F.col("r.root").alias("root"), "digest")


def sieve(keys: DataFrame) -> np.ndarray:
    """SIEVE bits, those set that the keys (one binary column) begin with; a fixed size, however many keys there are."""

    def run(batches):
        bits = np.zeros(SIEVE, bool)
        for batch in batches:
            bits[places(batch.column(0))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(SIEVE // 8, np.uint8)
    for row in keys.coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(out).astype(bool)


def places(keys) -> np.ndarray:
    return np.array([int.from_bytes(x[:4], "little") for x in keys.to_pylist()], np.int64) % SIEVE


def shingle_sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(digest, shingles) of the sets wanted (digest), and of some others; at most once for each task that meets one."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(sieve(wanted)))  # SIEVE bits

    def run(batches):
        bits, met = np.unpackbits(sent.value).astype(bool), set()
        for batch in batches:
            keys, sets = [], []
            for x in batch.column(0):
                found = np.unique(shingle_hashes(x.as_py() or "", words))
                key = digest(found)
                if bits[int.from_bytes(key[:4], "little") % SIEVE] and key not in met:
                    met.add(key)
                    keys.append(key)
                    sets.append(found.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    return pick(docs, "text").mapInArrow(run, "digest binary, shingles binary")


def similar(sets: list[np.ndarray], side: np.ndarray, least: float) -> np.ndarray:
    """Edges (i, j) that join the sets as all pairs of Jaccard `least` or more would; side as in links().

    Each set is counted against all later ones of its similarity's sizes that no link
    has joined with it yet, so a group of near copies takes few rounds.
    """
    size = np.array([len(x) for x in sets])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    root, mark = np.arange(len(sets)), np.zeros(len(names), bool)
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[(root[j] != root[i]) & ((side[j] == 0) | (side[j] != side[i]))]
        j = j[(size[j] >= least * size[i] - 1) & (size[i] >= least * size[j] - 1) & (size[j] > 0)]
        if not len(j) or not size[i]:
            continue
        own = ids[begin[i] : begin[i] + size[i]]
        mark[own] = True
        ends = np.cumsum(size[j])
        at = np.arange(ends[-1]) + np.repeat(begin[j] - ends + size[j], size[j])
        both = np.add.reduceat(mark[ids[at]].astype(np.int64), ends - size[j])
        mark[own] = False
        j = j[both >= least * (size[i] + size[j] - both) - 1e-9]
        root = joined(root, np.full(len(j), i), j)
    to = np.flatnonzero(root != np.arange(len(sets)))
    return np.stack([root[to], to], 1)


def set_keys(table: pa.Table, names: tuple[str, ...]) -> list[tuple[int, int]]:
    """(begin, end) of the rows that agree in the columns, which come together."""
    keys = list(zip(*(table.column(c).to_pylist() for c in names)))
    begin = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
    return [*zip(begin, [*begin[1:], len(keys)])]


def near_centres(rows: DataFrame, least: float) -> DataFrame:
    """(root, digest, near, centre) of the sets of large roots: whether a set has a similarity of `least` or more with its root's least digest.

    Each block of a root gets its own rows and the centre, so the work grows with the rows.
    """
    centres = rows.groupBy("root", "blocks").agg(F.min("digest").alias("digest"))
    centres = rows.join(centres, ["root", "blocks", "digest"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    names = ("root", "block", "own", "digest", "shingles")
    both = centres.withColumn("own", F.lit(False)).select(*names).unionByName(own.withColumn("own", F.lit(True)).select(*names))
    both = both.repartition("root", "block").sortWithinPartitions("root", "block", "own", "digest")

    def look(batches):
        now, centre, kept = None, None, None
        for batch in batches:
            out = ([], [], [], [])
            for root, block, mine, digest, raw in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.frombuffer(raw, "<u8")
                if (root, block) != now:  # the centre comes first
                    now, centre, kept = (root, block), digest, found
                if mine:
                    both = len(np.intersect1d(found, kept, assume_unique=True))
                    for column, x in zip(out, (root, digest, both >= least * (len(found) + len(kept) - both) - 1e-9, centre)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.binary(), pa.binary(), pa.bool_(), pa.binary()))], ["root", "digest", "near", "centre"])

    return both.mapInArrow(look, "root binary, digest binary, near boolean, centre binary")


def link_sets(sets: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """Edges (a, b) between digests whose sets have a Jaccard similarity of `least` or more, as far as their components go.

    sets: (root, digest), a digest under any number of roots; all pairs of a root are told
    apart by their whole sets. Roots of more than SETS sets are first compared with one set each, their centre: those near
    it are one component already, so that only pairs with one of the rest are left.
    These go in blocks of SETS, each pair of blocks by itself; a group of near copies
    leaves few or none.
    """
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    several = attach(sets, sizes.withColumn("_sets", F.col("_n")), "root", "_n").where("_sets > 1")
    several = written(several.select("digest", "root", F.ceil(F.col("_sets") / SETS).cast("int").alias("blocks")))
    rows = written(shingle_sets(docs, words, several.select("digest")).dropDuplicates(["digest"]).join(several, "digest"))
    large = rows.where("blocks > 1")
    told = written(near_centres(large, least))
    number = told.groupBy("root").agg(F.ceil(F.count_if("near") / SETS).cast("int").alias("n_near"), F.ceil(F.count_if(~F.col("near")) / SETS).cast("int").alias("n_rest"), F.count(F.lit(1)).alias("_n"))
    parts = attach(large.join(told.select("root", "digest", "near"), ["root", "digest"]), number, "root", "_n").where("n_rest > 0")
    block = F.pmod(F.xxhash64("digest"), F.when(F.col("near"), F.col("n_near")).otherwise(F.col("n_rest"))).cast("int")
    pair = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(upto("n_rest"), lambda o: pair(F.least(o, block), F.greatest(o, block), F.when(o == block, 0).when(block < o, 1).otherwise(2)))
    # Blocks of near sets count down from -1, so that they come before any of the rest.
    across = F.when(F.col("n_near") > 0, F.transform(upto("n_near"), lambda o: pair(-1 - o, block, F.lit(2)))).otherwise(F.array().cast("array<struct<low:int,high:int,side:int>>"))
    pairs = F.when(F.col("near"), F.transform(upto("n_rest"), lambda o: pair(-1 - block, o, F.lit(1)))).otherwise(F.concat(among, across))
    names = ("root", "low", "high", "side", "digest", "shingles")
    parts = parts.withColumn("p", F.explode(pairs)).select("root", "p.low", "p.high", "p.side", "digest", "shingles")
    whole = rows.where("blocks = 1").withColumns({c: F.lit(0) for c in names[1:4]}).select(*names)
    compared = whole.unionByName(parts).repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "digest")

    def compare(batches):
        for table in batched(batches, 3, SETS):
            digests, raw, side = table.column("digest").to_pylist(), table.column("shingles").to_pylist(), table.column("side").to_numpy()
            for a, b in set_keys(table, ("root", "low", "high")):
                if b - a > 1:
                    found = similar([np.frombuffer(x, "<u8") for x in raw[a:b]], side[a:b], least)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([digests[a + k] for k in found[:, c]], pa.binary()) for c in (0, 1)], ["a", "b"])

    starred = told.where("near and digest <> centre").select(F.col("centre").alias("a"), F.col("digest").alias("b"))
    return starred.unionByName(compared.mapInArrow(compare, "a binary, b binary"))


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, bits: int = 512, radius: int = 116) -> DataFrame:
    """(doc_id, digest, component_id) of each row: links are pairs of shingle sets of Jaccard `least` or more.

    SimHash within radius only finds what is compared: the whole sets of all rows that
    its links lead to are compared with each other, and only verified pairs link. Sets of
    few shingles, for which SimHash is least sure, are also compared where they share one
    of their rarest: of pairs whose smaller set has SHORT at most none is missed. Rows of
    one set, texts without words among them, are one node.
    """
    rows = checkpointed(set_rows(docs, words, bits, math.floor(SHORT / least + 1e-9)))
    sets = checkpointed(rows.groupBy("digest").agg(F.first("print").alias("print"), F.first("few").alias("few"), F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    prints = checkpointed(sets.groupBy("print").agg(F.count(F.lit(1)).alias("_sets")))
    near = components(link_prints(prints.select("print"), bits, radius)).withColumnRenamed("node", "print")
    candidates = sets.select("print", "digest").join(near, "print", "left").select(F.coalesce("root", "print").alias("root"), "digest")
    candidates = candidates.unionByName(written(rare_roots(sets, least)))
    found = components(link_sets(candidates, docs, words, least))
    rooted = sets.join(found, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest"))
    first = rooted.groupBy("root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_digests"))
    named = attach(rooted.select("root", "digest", "_n"), first, "root", "_digests").drop("root")
    return attach(rows.drop("print", "few"), named, "digest", "_n").select("doc_id", "digest", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, bits: int = 512, radius: int = 116, least: float = 0.8) -> DataFrame:
    """docs without the rows that are near-duplicates of a row with a smaller doc_id; columns as they were.

    Near are word shingles of Jaccard `least` or more, and what such pairs join. 512
    bits at radius 116 only find the candidates: two sets at Jaccard 0.8 have the cosine
    0.89 and differ in 78 bits on average, so the radius is more than four deviations
    off (fewer for sets of less than ten shingles). What is missed is in README. Of
    rows with one doc_id one stays, that whose text has the least hash, then whose columns
    have; rows with a null doc_id all stay.
    """
    kept = similar_groups(docs, words, least, bits, radius).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = f"c{docs.columns.index('doc_id')}"
    kept = plain.join(kept, plain[own] == kept["_kept"], "left_semi")
    text, hashed = f"c{docs.columns.index('text')}", [c for c, kind in plain.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.md5(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(*hashed))
    first = kept.groupBy(F.col(own).alias("_own")).agg(F.min_by(F.struct(*plain.columns), order).alias("row")).select("row.*")
    return first.unionByName(plain.where(F.col(own).isNull())).toDF(*docs.columns)
