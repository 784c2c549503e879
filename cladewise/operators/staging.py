"""Records through the filters, as staging rows and counts."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.exprs import count_ambiguous, deepest_rank
from ..functions.hashing import sequence_hash
from ..functions.schema import EXCLUSIONS, RANKS, STAGING, Filters


def length_reason(filters: Filters, length: Column | str = "length", marker: Column | str = "marker") -> Column:
    """too_short or too_long for the marker, null if neither; bounds are inclusive."""
    length = F.col(length) if isinstance(length, str) else length
    marker = F.col(marker) if isinstance(marker, str) else marker
    low, high = F.lit(filters.min_length), F.lit(filters.max_length)
    for name, least, most in filters.by_marker:
        low, high = F.when(marker == name, least).otherwise(low), F.when(marker == name, most).otherwise(high)
    return F.when(length < low, "too_short").when(length > high, "too_long")


def ambiguity_reason(filters: Filters, n_ambiguous: Column | str = "n_ambiguous", length: Column | str = "length") -> Column:
    """F02"""
    n = F.col(n_ambiguous) if isinstance(n_ambiguous, str) else n_ambiguous
    length = F.col(length) if isinstance(length, str) else length
    return F.when(n > F.lit(filters.max_ambiguous) * length, "too_ambiguous")


def filtered(parsed: DataFrame, filters: Filters) -> DataFrame:
    """parsed rows with length, n_ambiguous and the first reason to leave them out."""
    rows = parsed.withColumn("length", F.length("sequence")).withColumn("n_ambiguous", count_ambiguous("sequence"))
    return rows.withColumn("exclusion", F.coalesce("exclusion", length_reason(filters), ambiguity_reason(filters)))


def staged(rows: DataFrame, impl: str = "blake2b") -> DataFrame:
    """Staging rows, and `ordinal`, of the filtered rows without an exclusion; hashes are made here and nowhere later."""
    kept = rows.where("exclusion is null").withColumn("seq_hash", sequence_hash("sequence", impl))
    names = F.transform("source_lineage", lambda t: t["name"])
    out = {f.name: F.col(f"`{f.name}`") for f in STAGING} | {"source_lineage": names}
    return kept.select(*(c.cast(STAGING[n].dataType).alias(n) for n, c in out.items()), "ordinal")


def zero_filled(counts: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """(key, n) of each value, 0 where it has no row."""
    every = counts.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{key}` string, _at int")
    return F.broadcast(every).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts(rows: DataFrame) -> DataFrame:
    """(source, n_read, n_kept, each reason, each deepest rank of kept rows) in one pass."""
    kept = F.col("exclusion").isNull()
    deepest = deepest_rank()
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(kept).alias("n_kept"),
        *(F.count_if(F.col("exclusion") == reason).alias(reason) for reason in EXCLUSIONS),
        *(F.count_if(kept & (deepest == rank)).alias(f"depth_{rank}") for rank in RANKS),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
