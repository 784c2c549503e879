"""Operator 3: exact top-k by inner product over an index of pivot distances."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .vectors import asked, by_length, checkpointed, distinct, matrix, meet, others, ranked, told, whole

#: Vectors of a block, which one task holds; queries of a chunk, which meets its own copy of a block.
BLOCK, CHUNK = 8192, 65_536
#: Pivots, and annuli around each, at most.
PIVOTS, ANNULI = 64, 32
#: Rows of an annulus that are looked at together.
SLICE = 512
#: Distances are doubles; squares that differ by less than this share of the scale count as equal, and are looked at.
SLACK = 1e-9


def lifted(v: np.ndarray, square: float) -> np.ndarray:
    """Vectors with one more component, so that all have the same norm.

    For a query with a zero there, the nearest by distance are those of the largest
    inner product: |q - x|^2 = |q|^2 + square - 2 q.x.
    """
    rest = np.maximum(square - np.einsum("ij,ij->i", v, v), 0)
    return np.c_[v, np.sqrt(rest)]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        d = x - p
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def best_in_block(v: np.ndarray, ids: list[list[int]], near: np.ndarray, q: np.ndarray, own: int, to_pivot: float, square: float, floor: float, most: int) -> list[tuple[int, float]]:
    """A query's `most` best (id, score) in a block sorted by distance to its pivot; scores below floor don't count.

    Annuli are looked at from the query's own distance outwards. By the triangle
    inequality a vector is at least |its distance - the query's| away, so once that
    exceeds the distance of the worst score kept, none further out can be better.
    """
    norm = float(q @ q)
    eps = SLACK * (norm + square + 1)
    low = high = int(np.searchsorted(near, to_pivot))
    scores, places = np.zeros(0), np.zeros(0, np.int64)
    worst = floor
    while low > 0 or high < len(near):
        below = to_pivot - near[low - 1] if low else math.inf
        above = near[high] - to_pivot if high < len(near) else math.inf
        gap = min(below, above)
        if worst > -math.inf and gap > 0 and gap * gap > norm + square - 2 * worst + eps:
            break
        if below <= above:
            part = slice(max(0, low - SLICE), low)
            low = part.start
        else:
            part = slice(high, min(len(near), high + SLICE))
            high = part.stop
        fresh = v[part] @ q
        kept = np.flatnonzero(fresh >= worst)
        scores, places = np.r_[scores, fresh[kept]], np.r_[places, kept + part.start]
        if len(scores) > most:  # one more than asked for: the query itself may be among them
            worst = max(worst, np.partition(scores, -most - 1)[-most - 1])
            kept = scores >= worst
            scores, places = scores[kept], places[kept]
    found = [(i, s) for s, k in zip(scores.tolist(), places.tolist()) for i in others(ids[k], own, bool((v[k] == q).all()))]
    return sorted(found, key=lambda x: (-x[1], x[0]))[:most]


def search(vectors: DataFrame, most: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query, a row whose vec_id is divisible by `every`, against all other rows.

    Vectors become floor(scale * x); score is their inner product. Doubles hold it
    exactly below 2^53; if the largest squared norm reaches that, it is a ValueError.
    Each distinct vector is indexed once with its smallest ids, so copies cost nothing.
    The key of a vector is its nearest pivot and its distance to it; pivots and annuli
    are bounded in number, blocks in size. A query first looks at its home block's
    annulus; with the score found there as a floor it visits only the blocks that the
    triangle inequality leaves. The queries of a block stream by it.

    Rows that share an id are queries and candidates each by itself; a row is left out
    only of its own candidates. Vectors of each length are searched by themselves. Null,
    empty and non-finite vectors and rows without id take no part; other columns are
    left out; an empty table gives no rows.
    """
    return by_length(checkpointed(whole(vectors, scale)), lambda rows: search_rows(rows, most, every))


def search_rows(rows: DataFrame, most: int, every: int) -> DataFrame:
    """search() over rows (vec_id, v) of one length."""
    classes = checkpointed(distinct(rows, most + 1))
    queries = checkpointed(asked(rows, every))
    count, n_queries = classes.count(), queries.count()
    empty = "query_id long, rank int, vec_id long, score long"
    if not count or not n_queries:
        return rows.sparkSession.createDataFrame([], empty)

    def norms(batches):
        for batch in batches:
            v = matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.einsum("ij,ij->i", v, v))], ["square"])

    square = classes.select("v").mapInArrow(norms, "square double").agg(F.max("square")).first()[0]
    if not square < 1 << 53:
        raise ValueError(f"the squared norm {square:g} is above 2^53: inner products would not be exact")
    sample = [np.frombuffer(r.v, "<f8") for r in classes.orderBy(F.xxhash64("v"), "v").select("v").limit(min(PIVOTS, math.ceil(count / BLOCK))).collect()]
    pivots = lifted(np.array(sample), square)

    def keyed(batches):
        for batch in batches:
            d = distances(lifted(matrix(batch.column(0)), square), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["v", "ids", "pivot", "near"])

    index = checkpointed(classes.mapInArrow(keyed, "v binary, ids array<long>, pivot int, near double"))
    # Borders of the annuli: so many quantiles of a pivot's distances as it has blocks.
    steps = [i / ANNULI for i in range(1, ANNULI)]
    borders = {r.pivot: (r.n, r.q) for r in index.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("near", steps, 1000).alias("q")).collect()}
    cuts = {p: sorted({q[int(i * ANNULI / k) - 1] for i in range(1, k)}) for p, (n, q) in borders.items() for k in [min(ANNULI, math.ceil(n / BLOCK))]}

    def ringed(batches):
        for batch in batches:
            pivot, near = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            ring = np.array([np.searchsorted(cuts[p], x) for p, x in zip(pivot, near)], np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring, pa.int32())], ["v", "ids", "pivot", "near", "ring"])

    index = index.mapInArrow(ringed, "v binary, ids array<long>, pivot int, near double, ring int")
    cells = {(r.pivot, r.ring): (r.n, r.low, r.high) for r in index.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("low"), F.max("near").alias("high")).collect()}  # PIVOTS x ANNULI at most
    parts = {c: math.ceil(n / (2 * BLOCK)) for c, (n, _, _) in cells.items()}
    chunks = math.ceil(n_queries / CHUNK)
    key = ["pivot", "ring", "part", "chunk"]
    columns = "pivot int, ring int, part int, chunk int, asks boolean, v binary, ids array<long>, near double, query_id long, which string, floor double"

    def dealt(batches):
        for batch in batches:
            v, ids, pivot, near, ring = batch.columns
            part = [zlib.crc32(x) % parts[c] for x, c in zip(v.to_pylist(), zip(pivot.to_pylist(), ring.to_pylist()))]
            n = len(part)
            for chunk in range(chunks):
                yield pa.RecordBatch.from_arrays([pivot, ring, pa.array(part, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([False] * n), v, ids, near, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())], [c.split()[0] for c in columns.split(", ")])

    blocks = index.mapInArrow(dealt, columns)

    def visits(home: bool):
        names = list(cells)
        which = np.array([c[0] for c in names])
        low, high = np.array([cells[c][1] for c in names]), np.array([cells[c][2] for c in names])

        def run(batches):
            for batch in batches:
                q = matrix(batch.column(1))
                to = distances(np.c_[q, np.zeros(len(q))], pivots)
                gap = np.maximum(0, np.maximum(low - to[:, which], to[:, which] - high))
                first = np.lexsort((to[:, which], gap))[:, 0]
                out = {"pivot": [], "ring": [], "part": [], "row": []}
                floors = None if home else np.array(batch.column(3).to_pylist(), float)
                for i in range(len(q)):
                    if home:
                        chosen = first[i : i + 1]
                    else:
                        norm = q[i] @ q[i]
                        reach = norm + square - 2 * floors[i] + SLACK * (norm + square + 1)
                        chosen = np.flatnonzero(gap[i] ** 2 <= reach)
                        chosen = chosen[chosen != first[i]]
                    for c in chosen.tolist():
                        for k in range(parts[names[c]]):
                            for name, x in zip(out, (*names[c], k, i)):
                                out[name].append(x)
                at, p, n = np.array(out["row"], np.int64), np.array(out["pivot"], np.int64), len(out["row"])
                ids = np.array(batch.column(0).to_pylist(), np.int64)
                bound = np.full(len(q), -np.inf) if home else floors
                yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int32()) for c in key[:3]), pa.array(ids[at] // every % chunks, pa.int32()), pa.array([True] * n), batch.column(1).take(pa.array(at)), pa.nulls(n, pa.list_(pa.int64())), pa.array(to[at, p]), pa.array(ids[at]), batch.column(2).take(pa.array(at)), pa.array(bound[at])], [c.split()[0] for c in columns.split(", ")])

        return run

    def look(block: pa.Table):
        block = block.sort_by([("near", "ascending"), ("v", "ascending")])
        v, near, ids = matrix(block["v"]), block["near"].to_numpy(), block["ids"].to_pylist()

        def each(asking: pa.Table) -> pa.Table:
            out: dict[str, list] = {"query_id": [], "which": [], "vec_id": [], "score": []}
            for own, which, q, to, floor in zip(asking["query_id"].to_pylist(), asking["which"].to_pylist(), matrix(asking["v"]), asking["near"].to_pylist(), asking["floor"].to_pylist()):
                for i, s in best_in_block(v, ids, near, q, own, to, square, floor, most):
                    for name, x in zip(out, (own, which, i, int(s))):
                        out[name].append(x)
            return pa.table({n: pa.array(x, pa.string() if n == "which" else pa.int64()) for n, x in out.items()})

        return each

    found = "query_id long, which string, vec_id long, score long"
    going = queries.select("vec_id", "v", "which")
    at_home = checkpointed(meet(blocks, going.mapInArrow(visits(True), columns), key, look, found))
    worst = ranked(at_home, most).groupBy("query_id", "which").agg(F.when(F.count(F.lit(1)) == most, F.min("score")).cast("double").alias("floor"))
    worst = worst.withColumnsRenamed({"query_id": "_id", "which": "_which"})
    going = going.join(worst, (F.col("vec_id") == F.col("_id")) & (F.col("which") == F.col("_which")), "left").select("vec_id", "v", "which", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    away = meet(blocks, going.mapInArrow(visits(False), columns), key, look, found)
    return told(ranked(at_home.unionByName(away), most), queries)
