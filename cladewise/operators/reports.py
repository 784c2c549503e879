"""G02 to G05, G16 to G21 and the search's summaries: counts over datasets and runs."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.schema import KINGDOMS, RANKS, SPLITS, UNKNOWN
from .staging import zero_filled


def split_counts(dataset: DataFrame) -> DataFrame:
    """G02"""
    return zero_filled(dataset.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", SPLITS)


def kingdom_counts(dataset: DataFrame) -> DataFrame:
    """Also of rows without kingdom."""
    named = dataset.groupBy(F.coalesce("kingdom", F.lit(UNKNOWN)).alias("kingdom")).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(named, "kingdom", (*KINGDOMS, UNKNOWN))


def marker_counts(dataset: DataFrame) -> DataFrame:
    """G04"""
    return dataset.groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


def rank_coverage(dataset: DataFrame) -> DataFrame:
    """(rank, n): rows with a name at each rank, from one pass."""
    one = dataset.agg(*(F.count(F.col(f"`{r}`")).alias(r) for r in RANKS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.col(f"`{r}`").alias("n")) for r in RANKS))).alias("x")).select("x.rank", "x.n")


def overview(frame: DataFrame) -> DataFrame:
    """By split: rows, synthetic rows, and the percentage with a genus and a species, one decimal."""
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")) * 100, 1)
    place = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    return frame.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("n_synthetic"), share("genus").alias("pct_genus"), share("species").alias("pct_species")).orderBy(place)


def real_and_synthetic(train: DataFrame) -> DataFrame:
    """G17"""
    return train.groupBy(F.coalesce("kingdom", F.lit(UNKNOWN)).alias("kingdom")).agg(F.count_if(~F.col("synthetic")).alias("n_real"), F.count_if("synthetic").alias("n_synthetic"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kingdom")


def coverage_percent(dataset: DataFrame) -> DataFrame:
    """G18"""
    one = dataset.agg(*(F.round(F.avg(F.col(f"`{r}`").isNotNull().cast("double")) * 100, 4).alias(r) for r in RANKS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.col(f"`{r}`").alias("pct")) for r in RANKS))).alias("x")).select("x.rank", "x.pct")


def by_kingdom(rows: DataFrame) -> DataFrame:
    """Most common first."""
    return rows.groupBy(F.coalesce("kingdom", F.lit(UNKNOWN)).alias("kingdom")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kingdom")


def trial_summary(trials: DataFrame) -> DataFrame:
    """(trials, completed, pruned, failed, best_value, best_number) of (number, state, value); of equal values the first trial."""
    done = F.col("state") == "COMPLETE"
    return trials.agg(F.count(F.lit(1)).alias("trials"), F.count_if(done).alias("completed"), F.count_if(F.col("state") == "PRUNED").alias("pruned"), F.count_if(F.col("state") == "FAIL").alias("failed"), F.max(F.when(done, F.col("value"))).alias("best_value"), F.expr("max_by(CASE WHEN state = 'COMPLETE' THEN number END, CASE WHEN state = 'COMPLETE' THEN struct(value, -number) END)").alias("best_number"))


def best_trials(trials: DataFrame, most: int = 10) -> DataFrame:
    """The trials of the highest values; those without value last."""
    return trials.orderBy(F.desc_nulls_last("value"), "number").limit(most)


def windowed_loss(steps: DataFrame) -> DataFrame:
    """The mean loss since the step before, from running means within each epoch."""
    order = Window.partitionBy("epoch").orderBy("step")
    before, earlier = F.coalesce(F.lag(F.col("loss") * F.col("step")).over(order), F.lit(0.0)), F.coalesce(F.lag("step").over(order), F.lit(0))
    return steps.withColumn("window_loss", (F.col("loss") * F.col("step") - before) / (F.col("step") - earlier))


def running_best(trials: DataFrame, study: str = "study") -> DataFrame:
    """The best value so far, by number within a study."""
    order = Window.partitionBy(study).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.max("value").over(order))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The epoch of least validation loss, the earliest of equals."""
    return epochs.agg(F.min_by(F.struct("epoch", "val_loss"), F.struct("val_loss", "epoch")).alias("b")).select("b.epoch", "b.val_loss")
