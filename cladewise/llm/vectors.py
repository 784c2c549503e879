"""Vectors as the searches take them: checked, and each distinct one once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import HOT_SLICES, checkpointed, least_ids, pick


def whole(vectors: DataFrame, scale: int = 0, zero: bool = True) -> DataFrame:
    """(vec_id long, v binary of doubles) of the rows whose vector is whole: not null, not empty, no null or non-finite component.

    scale: each component x becomes floor(scale * x). Without `zero`, vectors of zeros
    go too. Rows without vec_id take no part.
    """
    rows = pick(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = v.values.to_numpy(zero_copy_only=False)
                if v.values.null_count or not np.isfinite(x).all() or not (zero or x.any()):
                    continue
                ids.append(i)
                out.append((np.floor(scale * x) if scale else x + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary").where(F.octet_length("v") > 0)


def valid(vectors: DataFrame, scale: int = 0, zero: bool = True) -> DataFrame:
    """Of the whole vectors, those of the most frequent length (of equally frequent ones the longest)."""
    rows = whole(vectors, scale, zero)
    lengths = rows.groupBy(F.octet_length("v").alias("_size")).count().orderBy(F.desc("count"), F.desc("_size")).limit(1)
    return rows.join(F.broadcast(lengths), F.octet_length("v") == F.col("_size"), "left_semi")


def by_length(rows: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """search() over the vectors of each length by itself, as vectors of two lengths have no product."""
    sizes = [r[0] for r in rows.select(F.octet_length("v")).distinct().orderBy(F.octet_length("v")).collect()]  # a few lengths
    parts = [search(rows if len(sizes) == 1 else rows.where(F.octet_length("v") == n)) for n in sizes]
    return reduce(DataFrame.unionByName, parts) if parts else search(rows)


def distinct(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): each distinct vector with the `most` smallest ids of its rows, in order; of no more can a result have use."""
    few = least_ids(rows.select("v", "vec_id"), "v", "vec_id", most)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def asked(rows: DataFrame, every: int) -> DataFrame:
    """(vec_id, v, which, times) of the queries: rows whose id is divisible by `every`; alike ones once, with their number.

    which: a digest of v, which tells rows that share an id apart.
    """
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("which", F.md5("v"))


def others(ids: list[int], own: int, same: bool) -> list[int]:
    """The ids of a distinct vector's rows but, if it is the query's own vector, for one row of the query's id."""
    if same and own in ids:
        ids = ids.copy()
        ids.remove(own)
    return ids


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column of doubles, a row each."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.zeros((0, 0))


def ranked(found: DataFrame, most: int) -> DataFrame:
    """(query_id, which, rank, vec_id, score): each query's best, ties to the smaller id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.select("query_id", "which", "rank", "vec_id", "score")


def told(best: DataFrame, queries: DataFrame) -> DataFrame:
    """The result: rows of ranked() once for each row of the query."""
    again = queries.where("times > 1").select(F.col("vec_id").alias("_id"), F.col("which").alias("_which"), F.explode(F.sequence(F.lit(2), F.col("times"))).alias("_time"))
    more = best.join(again, (F.col("query_id") == F.col("_id")) & (F.col("which") == F.col("_which")))
    names = ("query_id", "rank", "vec_id", "score")
    return best.select(*names).unionByName(more.select(*names))


def meet(blocks: DataFrame, queries: DataFrame, key: list[str], look: Callable, schema: str) -> DataFrame:
    """look(block's table, queries' table) for each key and each batch of its queries.

    blocks and queries have the same columns and are told apart by `asks` (false, true).
    The rows of a block come first and are kept, a bounded number; its queries stream by.
    """
    both = blocks.unionByName(queries)
    rows = both.repartition(*key).sortWithinPartitions(*key, "asks")

    def run(batches):
        now, kept, ready = None, [], None
        for batch in batches:
            parts = [batch.column(k).to_pylist() for k in range(len(key))]
            marks = list(zip(*parts, batch.column(batch.schema.get_field_index("asks")).to_pylist()))
            begin = [k for k in range(len(marks)) if not k or marks[k] != marks[k - 1]]
            for a, b in zip(begin, [*begin[1:], len(marks)]):
                part = batch.slice(a, b - a)
                if marks[a][:-1] != now:
                    now, kept, ready = marks[a][:-1], [], None
                if not marks[a][-1]:
                    kept.append(part)
                elif kept:
                    if ready is None:
                        ready = look(pa.Table.from_batches(kept))
                    out = ready(pa.Table.from_batches([part]))
                    yield from out.to_batches()

    return rows.mapInArrow(run, schema)


__all__ = ["HOT_SLICES", "asked", "by_length", "checkpointed", "distinct", "matrix", "meet", "others", "ranked", "told", "valid", "whole"]
