"""Operator 7: approximate nearest neighbours by robust-pruned directed graphs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .vectors import asked, by_length, checkpointed, distinct, matrix, meet, others, ranked, told, whole

#: Vectors of a shard, each with a graph of its own. Above MOST_SHARDS shards they grow, up to LARGEST vectors.
SHARD, MOST_SHARDS, LARGEST = 6_000, 1_000, 200_000
#: Queries of a chunk, which meets its own copy of a graph.
CHUNK = 65_536
#: Edges of a node, width of the beam when building and when asking, and how much nearer a kept neighbour must be to drop another one.
DEGREE, BUILD_BEAM, BEAM, RELAXED = 32, 48, 96, 1.2
#: Nodes that are put into the graph together.
TOGETHER = 256


def beam(unit: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries at once: (nodes, distances) of each one's beam, nearest first; -1 where it is short.

    In each round every query opens the nearest node of its beam not opened yet and
    takes in its neighbours; it ends when the whole beam is opened.
    """
    n = len(queries)
    nodes = np.full((n, width), -1, np.int64)
    near = np.full((n, width), np.inf, np.float32)
    opened = np.zeros((n, width), bool)
    met = np.zeros((n, len(unit) + 1), bool)  # the last for -1
    nodes[:, 0], met[:, start] = start, True
    near[:, 0] = 1 - queries @ unit[start]
    going = np.arange(n)
    while len(going):
        open_ = np.where(opened[going] | (nodes[going] < 0), np.inf, near[going])
        at = open_.argmin(1)
        more = open_[np.arange(len(going)), at] < np.inf
        going, at = going[more], at[more]
        if not len(going):
            break
        opened[going, at] = True
        fresh = edges[nodes[going, at]]
        known = (fresh < 0) | met[going[:, None], fresh]
        met[going[:, None], fresh] = True
        d = 1 - np.einsum("qed,qd->qe", unit[fresh], queries[going])
        d[known] = np.inf
        all_near = np.concatenate([near[going], d], 1)
        all_nodes = np.concatenate([nodes[going], np.where(known, -1, fresh)], 1)
        all_open = np.concatenate([opened[going], np.zeros(d.shape, bool)], 1)
        best = np.argsort(all_near, axis=1, kind="stable")[:, :width]
        near[going] = np.take_along_axis(all_near, best, 1)
        nodes[going] = np.take_along_axis(all_nodes, best, 1)
        opened[going] = np.take_along_axis(all_open, best, 1)
    nodes[~np.isfinite(near)] = -1
    return nodes, near


def pruned(unit: np.ndarray, of: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours of each node among its candidates (-1: none).

    The nearest candidate is kept; those that it is RELAXED times nearer to than the
    node itself are dropped; and so on with the nearest one left.
    """
    order = np.sort(candidates, 1)
    twice = np.concatenate([np.zeros((len(order), 1), bool), order[:, 1:] == order[:, :-1]], 1)
    alive = (order >= 0) & ~twice & (order != of[:, None])
    points = unit[order]
    d = np.where(alive, 1 - np.einsum("ncd,nd->nc", points, unit[of]), np.inf)
    out = np.full((len(of), DEGREE), -1, np.int64)
    rows = np.arange(len(of))
    for k in range(DEGREE):
        at = d.argmin(1)
        some = np.isfinite(d[rows, at])
        if not some.any():
            break
        out[some, k] = order[rows, at][some]
        kept = points[rows, at]
        between = 1 - np.einsum("ncd,nd->nc", points, kept)
        d[(RELAXED * between <= d) | (np.arange(d.shape[1]) == at[:, None])] = np.inf
    return out


def build(unit: np.ndarray) -> tuple[np.ndarray, int]:
    """(edges, start) of the graph over unit vectors: node by node, from the medoid's side.

    Each batch of nodes searches the graph so far for its neighbours, keeps the diverse
    ones, and gives each of them an edge back; nodes with too many edges are pruned anew.
    """
    n = len(unit)
    centre = unit.mean(0)
    start = int((unit @ centre).argmax())
    rng = np.random.RandomState(n)
    order = np.r_[start, rng.permutation(np.delete(np.arange(n), start))]
    edges = np.full((n, DEGREE), -1, np.int64)
    done = 1
    while done < n:
        batch = order[done : done + max(1, min(TOGETHER, done))]
        found, _ = beam(unit, edges, start, unit[batch], BUILD_BEAM)
        edges[batch] = pruned(unit, batch, np.concatenate([found, np.tile(batch[:16], (len(batch), 1))], 1))
        source = np.repeat(batch, DEGREE)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, number = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), DEGREE + int(number.max(initial=0))), -1, np.int64)
        wide[:, :DEGREE] = edges[nodes]
        row = np.repeat(np.arange(len(nodes)), number)
        wide[row, DEGREE + np.arange(len(target)) - first[row]] = source
        room = (edges[nodes] < 0).sum(1) >= number
        for k in np.flatnonzero(room):
            free = np.flatnonzero(edges[nodes[k]] < 0)[: number[k]]
            fresh = source[first[k] : first[k] + number[k]]
            edges[nodes[k], free] = np.where(np.isin(fresh, edges[nodes[k]]), -1, fresh)
        if (~room).any():
            edges[nodes[~room]] = pruned(unit, nodes[~room], wide[~room])
        done += len(batch)
    return edges, start


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components to about 1, so that no square over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def cosines(v: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, each by the same order of additions."""
    return (v * q).sum(1) / (norms * math.sqrt((q * q).sum()))


def search(vectors: DataFrame, most: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query, a row whose vec_id is divisible by `every`: the nearest by cosine found among all other rows.

    Distinct vectors are dealt by hash to shards; each shard gets a graph over all its
    vectors, written to the checkpoint folder. The queries stream by each shard's graph,
    which they search with a beam of BEAM, and the shards' best are merged; scores are
    computed anew from the original vectors, scaled by powers of two, so that any finite
    magnitude will do.

    Equal vectors are one node with its smallest ids, so any number of copies is found.
    Rows that share an id are queries and candidates each by itself; a row is left out
    only of its own candidates. Vectors of each length are searched by themselves. Zero,
    null, empty and non-finite vectors and rows without id take no part; other columns
    are left out; an empty table gives no rows.
    """
    return by_length(checkpointed(whole(vectors, zero=False)), lambda rows: search_rows(rows, most, every))


def search_rows(rows: DataFrame, most: int, every: int) -> DataFrame:
    """search() over rows (vec_id, v) of one length."""
    classes = distinct(rows, most + 1)
    queries = checkpointed(asked(rows, every))
    count = rows.select("v").distinct().count()
    shards = max(1, math.ceil(count / min(LARGEST, max(SHARD, count / MOST_SHARDS))))
    chunks = max(1, math.ceil(queries.count() / CHUNK))
    classes = classes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    columns = "shard int, chunk int, asks boolean, v binary, ids binary, ends binary, edges binary, start int, query_id long, which string"
    names = [c.split()[0] for c in columns.split(", ")]

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("v")
        v = matrix(table["v"])
        near = scaled(v)
        edges, start = build((near / np.sqrt((near * near).sum(1))[:, None]).astype(np.float32))
        flat = table["ids"].combine_chunks()
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "v": pa.array([v.astype("<f8").tobytes()], pa.binary()), "ids": pa.array([flat.values.to_numpy().astype("<i8").tobytes()], pa.binary()), "ends": pa.array([flat.offsets.to_numpy()[1:].astype("<i4").tobytes()], pa.binary()), "edges": pa.array([edges.astype("<i4").tobytes()], pa.binary()), "start": pa.array([start], pa.int32())})

    graphs = checkpointed(classes.groupBy("shard").applyInArrow(make, "shard int, v binary, ids binary, ends binary, edges binary, start int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = graphs.withColumn("chunk", each(chunks)).withColumns({"asks": F.lit(False), "query_id": F.lit(None).cast("long"), "which": F.lit(None).cast("string")}).select(*names)
    none = {c: F.lit(None).cast("binary") for c in ("ids", "ends", "edges")} | {"start": F.lit(None).cast("int")}
    asking = queries.select("v", F.col("vec_id").alias("query_id"), "which", F.pmod(F.xxhash64("vec_id", "which"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("asks")).withColumn("shard", each(shards)).withColumns(none).select(*names)

    def look(graph: pa.Table):
        g = {n: graph[n][0].as_py() for n in ("v", "ids", "ends", "edges", "start")}
        ends = np.frombuffer(g["ends"], "<i4")
        begins = np.r_[0, ends[:-1]]
        raw = np.frombuffer(g["v"], "<f8").reshape(len(ends), -1)
        ids, edges = np.frombuffer(g["ids"], "<i8"), np.frombuffer(g["edges"], "<i4").reshape(len(ends), -1).astype(np.int64)
        v = scaled(raw)
        norms = np.sqrt((v * v).sum(1))
        unit = (v / norms[:, None]).astype(np.float32)

        def search(asking: pa.Table) -> pa.Table:
            out: dict[str, list] = {"query_id": [], "which": [], "vec_id": [], "score": []}
            own_ids, which, own = asking["query_id"].to_pylist(), asking["which"].to_pylist(), matrix(asking["v"])
            q = scaled(own)
            wanted = (q / np.sqrt((q * q).sum(1))[:, None]).astype(np.float32)
            for at in range(0, len(q), TOGETHER):
                nodes, _ = beam(unit, edges, g["start"], wanted[at : at + TOGETHER], max(BEAM, most + 1))
                for i, near in enumerate(nodes, at):
                    near = near[near >= 0]
                    found = [(int(j), s) for k, s in zip(near, cosines(v[near], norms[near], q[i]).tolist()) for j in others(ids[begins[k] : ends[k]].tolist(), own_ids[i], bool((raw[k] == own[i]).all()))]
                    for j, s in sorted(found, key=lambda y: (-y[1], y[0]))[:most]:
                        for name, value in zip(out, (own_ids[i], which[i], j, s)):
                            out[name].append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64())
            return pa.table({n: pa.array(x, k) for (n, x), k in zip(out.items(), kinds)})

        return search

    found = meet(graphs, asking, ["shard", "chunk"], look, "query_id long, which string, vec_id long, score double")
    return told(ranked(found, most), queries)
