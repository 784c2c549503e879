"""Reports over predictions, loss, predictions that abstain."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.exprs import level_accuracy
from ..functions.schema import IGNORED


def class_counters(predictions: DataFrame, by: tuple[str, ...] = ("level",)) -> DataFrame:
    """(by, class, hits, predicted, actual) of (by, target, predicted); rows with an ignored target don't count."""
    known = predictions.where(F.col("target") != IGNORED)
    sides = F.array(F.struct(F.col("target").alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("target") == F.col("predicted")).cast("int").alias("h")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("h")))
    rows = known.select(*by, F.explode(sides).alias("x"))
    return rows.groupBy(*by, F.col("x.class").alias("class")).agg(F.sum("x.h").alias("hits"), F.sum("x.p").alias("predicted"), F.sum("x.a").alias("actual"))


def level_report(counters: DataFrame, by: tuple[str, ...] = ("level",)) -> DataFrame:
    """Accuracy, macro and weighted precision, recall and F1 over the classes with support, support, classes."""
    p, r = F.col("hits") / F.greatest("predicted", F.lit(1)), F.col("hits") / F.greatest("actual", F.lit(1))
    rows = counters.withColumn("_p", p).withColumn("_r", r).withColumn("_f", F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0))
    there = F.col("actual") > 0
    nan = F.lit(float("nan"))
    macro = lambda c: F.coalesce(F.avg(F.when(there, F.col(c))), nan)
    weighted = lambda c: F.when(F.sum("actual") == 0, nan).otherwise(F.sum(F.col(c) * F.col("actual")) / F.sum("actual"))
    return rows.groupBy(*by).agg(
        level_accuracy(F.sum("hits"), F.sum("actual")).alias("accuracy"),
        *(macro(f"_{x}").alias(f"macro_{n}") for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))),
        *(weighted(f"_{x}").alias(f"weighted_{n}") for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))),
        F.sum("actual").alias("support"),
        F.count_if(there).alias("classes"),
    )


def group_reports(predictions: DataFrame, group: str = "marker") -> DataFrame:
    """The report of each group and of all rows ('all') from one pass: the counters of all are sums of the groups'."""
    counters = class_counters(predictions, (group, "level"))
    sums = F.expr("sum(hits)"), F.expr("sum(predicted)"), F.expr("sum(actual)")
    both = counters.groupingSets([["level", "class"], [group, "level", "class"]], group, "level", "class").agg(*(s.alias(n) for s, n in zip(sums, ("hits", "predicted", "actual"))), F.grouping(group).alias("_all"))
    named = both.withColumn(group, F.when(F.col("_all") == 1, "all").otherwise(F.col(group))).drop("_all")
    return level_report(named, (group, "level"))


def level_hits(predictions: DataFrame) -> DataFrame:
    """(level, hits, known)."""
    known = F.col("target") != IGNORED
    return predictions.groupBy("level").agg(F.count_if(known & (F.col("target") == F.col("predicted"))).alias("hits"), F.count_if(known).alias("known"))


def hierarchical_loss(rows: DataFrame) -> DataFrame:
    """(loss): the mean over levels of the mean -ln p_target of their labelled rows, of (level, target, p_target)."""
    per = rows.where(F.col("target") != IGNORED).groupBy("level").agg(F.avg(-F.ln("p_target")).alias("l"))
    return per.agg(F.avg("l").alias("loss"))


def abstaining(rows: DataFrame, threshold: float, row: str = "row_id") -> DataFrame:
    """(row, level_no, predicted, confidence): once a level's confidence is below the threshold, it and all deeper ones say -1."""
    order = Window.partitionBy(row).orderBy("level_no").rowsBetween(Window.unboundedPreceding, 0)
    sure = F.min("confidence").over(order) >= threshold
    return rows.withColumn("_sure", sure).withColumn("predicted", F.when(F.col("_sure"), F.col("predicted")).otherwise(-1)).drop("_sure")


def objective(levels: DataFrame, chosen: tuple[str, ...] = ("genus", "species")) -> DataFrame:
    """The mean accuracy of the chosen levels of (level, accuracy)."""
    return levels.where(F.col("level").isin(*chosen)).agg(F.avg("accuracy").alias("objective"))
