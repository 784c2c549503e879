"""Records with one sequence merged, their conflicts cut at the lowest common ancestor."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.schema import MERGED, RANKS

#: Pairs of a rank and one above it; a record's gaps have two bits for each.
PAIRS = len(RANKS) * (len(RANKS) - 1) // 2


def above(i: int) -> tuple[int, int]:
    """(first bit, mask) of the pairs of rank i."""
    return i * (i - 1) // 2, (1 << i) - 1


def names() -> Column:
    """The ranks that have a name which isn't empty, a bit for each."""
    return sum((F.when(F.col(f"`{r}`") != "", F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RANKS)), F.lit(0)).cast("long")


def gaps(named: Column) -> Column:
    """Of `names`, told once for each record: for each rank with a name, which ranks above have one (low bits) and which have none or an empty one (high bits); `or` adds records up."""

    def of(i: int, rank: str) -> Column:
        first, mask = above(i)
        bits = F.shiftleft(named.bitwiseAND(F.lit(mask)), first).bitwiseOR(F.shiftleft(F.bitwise_not(named).bitwiseAND(F.lit(mask)), PAIRS + first))
        return F.when(F.col(f"`{rank}`").isNotNull(), bits).otherwise(F.lit(0).cast("long"))

    return reduce(Column.bitwiseOR, (of(i, r) for i, r in enumerate(RANKS) if i))


def merged(staged: DataFrame, order: tuple[str, ...] = ("source_ordinal", "ordinal"), sort: bool = False, key: str = "seq_hash") -> DataFrame:
    """One row for each seq_hash, by one shuffle with partial aggregation.

    `key` may be another column that tells the same groups: rows that lie sorted by it,
    as after a join, are merged as they come, neither shuffled nor sorted again.

    Records disagree at a rank if their keys there, names from the domain down with
    nulls as "", have two values; a record that is only shallower has none and agrees
    with all. A rank in conflict and all below become null, so does a kingdom with two
    values; a conflict of domains drops the row. The marker is that of the first record
    by `order`; missing order columns don't count.

    Records are sorted to be merged, so they carry no keys: the first rank where two keys
    part has two names, told by min and max, or a name in one record and a gap in another
    that goes deeper, told by `gaps`.
    """
    keyed = staged.withColumn("_names", names()).withColumn("_gaps", gaps(F.col("_names")))
    order = tuple(c for c in order if c in staged.columns)
    has_marker = "marker" in staged.columns
    marker = [F.min_by("marker", F.struct(*order)).alias("marker") if order else F.min("marker").alias("marker")] if has_marker else []
    groups = keyed.groupBy(F.col(key).alias("_key")).agg(
        F.any_value("seq_hash").alias("seq_hash"),
        F.any_value("sequence").alias("sequence"),
        F.any_value("length").alias("length"),
        F.any_value("n_ambiguous").alias("n_ambiguous"),
        *marker,
        *(F.max(F.col(f"`{r}`")).alias(f"_n_{r}") for r in RANKS),
        *(F.coalesce(F.min(F.col(f"`{r}`")) != F.max(F.col(f"`{r}`")), F.lit(False)).alias(f"_two_{r}") for r in RANKS),
        F.bit_or("_gaps").alias("_gaps"),
        F.max("kingdom").alias("_kingdom"),
        F.coalesce(F.min("kingdom") != F.max("kingdom"), F.lit(False)).alias("_c_kingdom"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_list(F.concat_ws(":", "source", "accession"))).alias("accessions"),
        F.count(F.lit(1)).cast("int").alias("n_records"),
    )

    def parted(i: int) -> Column:
        first, mask = above(i)
        both = F.shiftright("_gaps", first).bitwiseAND(F.shiftright("_gaps", PAIRS + first)).bitwiseAND(F.lit(mask))
        return F.col(f"_two_{RANKS[i]}") | (both != 0)

    cut = {r: reduce(or_, (parted(x) for x in range(i + 1))) for i, r in enumerate(RANKS)}
    named = groups.select(
        "*",
        *(F.when(~cut[r], F.col(f"_n_{r}")).alias(r) for r in RANKS),
        F.when(~F.col("_c_kingdom"), F.col("_kingdom")).alias("kingdom"),
        (cut["species"] | F.col("_c_kingdom")).alias("label_conflict"),
    )
    rows = named.where("domain is not null").select(*(f"`{c}`" for c in MERGED if has_marker or c != "marker"))
    return rows.orderBy("seq_hash") if sort else rows


def merge_report(staged: DataFrame, merged_rows: DataFrame) -> DataFrame:
    """(staged, unique, kept, merged, conflicts, domain_conflicts), a row; domain_conflicts = unique - kept."""
    before = staged.agg(F.count(F.lit(1)).alias("staged"), F.count_distinct("seq_hash").alias("unique"))
    after = merged_rows.agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("n_records") > 1).alias("merged"), F.count_if("label_conflict").alias("conflicts"))
    both = before.join(F.broadcast(after), F.lit(True))  # a row with a row
    return both.withColumn("domain_conflicts", F.col("unique") - F.col("kept"))
