"""G12 to G15, G19 to G21, C04, C05 and the searches' sorts over derived predictions and runs."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators import metrics, reports
from .adapters import read
from .catalog import query

#: A prediction at two levels for each part: targets and guesses from sizes; a seventh has no known target.
PARTS = "SELECT p_partkey AS row_id, p_brand AS marker, CASE WHEN p_partkey % 7 = 0 THEN -100 ELSE p_size % 10 END AS t1, CASE WHEN p_partkey % 5 = 0 THEN (p_size + 1) % 10 ELSE p_size % 10 END AS g1, CASE WHEN p_partkey % 3 = 0 THEN -100 ELSE p_size % 23 END AS t2, CASE WHEN p_partkey % 4 = 0 THEN (p_size * 3) % 23 ELSE p_size % 23 END AS g2, p_partkey % 100 / 100.0 AS c1, p_partkey % 37 / 37.0 AS c2 FROM part"
PREDICTIONS_SQL = f"SELECT row_id, marker, 'genus' AS level, 1 AS level_no, t1 AS target, g1 AS predicted, c1 AS confidence FROM ({PARTS}) UNION ALL SELECT row_id, marker, 'species', 2, t2, g2, c2 FROM ({PARTS})"


def predictions(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(PREDICTIONS_SQL)


def counters_sql(by: str) -> str:
    return f"SELECT {by}, class, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(a) AS BIGINT) AS actual FROM (SELECT {by}, target AS class, 1 AS a, 0 AS p, CASE WHEN target = predicted THEN 1 ELSE 0 END AS h FROM p WHERE target <> -100 UNION ALL SELECT {by}, predicted, 0, 1, 0 FROM p WHERE target <> -100) GROUP BY {by}, class"


def report_sql(by: str, counters: str) -> str:
    return (
        f"SELECT {by}, round(sum(hits) / sum(actual), 9) AS accuracy, round(avg(pr) FILTER (actual > 0), 9) AS macro_precision, round(avg(re) FILTER (actual > 0), 9) AS macro_recall, round(avg(f) FILTER (actual > 0), 9) AS macro_f1, "
        f"round(sum(pr * actual) / sum(actual), 9) AS weighted_precision, round(sum(re * actual) / sum(actual), 9) AS weighted_recall, round(sum(f * actual) / sum(actual), 9) AS weighted_f1, CAST(sum(actual) AS BIGINT) AS support, count(*) FILTER (actual > 0) AS classes "
        f"FROM (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM (SELECT *, hits / greatest(predicted, 1) AS pr, hits / greatest(actual, 1) AS re FROM ({counters}))) GROUP BY {by}"
    )


ROUNDED = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")


def rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ROUNDED})


@query("G12_class_counters", f"WITH p AS ({PREDICTIONS_SQL}) {counters_sql('level')}")
def g12(spark, sf):
    return metrics.class_counters(predictions(spark, sf))


@query("G13_level_report", f"WITH p AS ({PREDICTIONS_SQL}) {report_sql('level', counters_sql('level'))}")
def g13(spark, sf):
    return rounded(metrics.level_report(metrics.class_counters(predictions(spark, sf))))


@query("G14_group_reports", f"WITH p AS (SELECT * FROM ({PREDICTIONS_SQL}) UNION ALL SELECT row_id, 'all', level, level_no, target, predicted, confidence FROM ({PREDICTIONS_SQL})) {report_sql('marker, level', counters_sql('marker, level'))}")
def g14(spark, sf):
    return rounded(metrics.group_reports(predictions(spark, sf)))


@query("G15_level_hits", f"SELECT level, count(*) FILTER (target <> -100 AND target = predicted) AS hits, count(*) FILTER (target <> -100) AS known FROM ({PREDICTIONS_SQL}) GROUP BY level")
def g15(spark, sf):
    return metrics.level_hits(predictions(spark, sf))


@query("C04_hierarchical_loss", f"SELECT round(avg(l), 5) AS loss FROM (SELECT level, avg(-ln(0.01 + confidence)) AS l FROM ({PREDICTIONS_SQL}) WHERE target <> -100 GROUP BY level)")
def c04(spark, sf):
    rows = predictions(spark, sf).withColumn("p_target", F.lit(0.01) + F.col("confidence"))
    return metrics.hierarchical_loss(rows).select(F.round("loss", 5).alias("loss"))


@query("C05_abstaining", f"SELECT row_id, level_no, CASE WHEN min(confidence) OVER (PARTITION BY row_id ORDER BY level_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 0.5 THEN predicted ELSE -1 END AS predicted FROM ({PREDICTIONS_SQL})")
def c05(spark, sf):
    return metrics.abstaining(predictions(spark, sf), 0.5).select("row_id", "level_no", "predicted")


#: Trials and training steps, from customers and events.
TRIALS = "SELECT c_custkey AS number, c_mktsegment AS study, CASE WHEN c_custkey % 3 = 0 THEN 'PRUNED' WHEN c_custkey % 17 = 1 THEN 'FAIL' ELSE 'COMPLETE' END AS state, CASE WHEN c_custkey % 17 = 1 THEN NULL ELSE c_acctbal END AS value FROM customer"
STEPS = "SELECT user_id AS epoch, CAST(event_id + 1 AS BIGINT) AS step, value AS loss FROM events"


def trials(spark, sf):
    read(spark, sf, "customer").createOrReplaceTempView("customer")
    return spark.sql(TRIALS)


@query("G19_trial_summary", f"SELECT count(*) AS trials, count(*) FILTER (state = 'COMPLETE') AS completed, count(*) FILTER (state = 'PRUNED') AS pruned, count(*) FILTER (state = 'FAIL') AS failed, max(value) FILTER (state = 'COMPLETE') AS best_value, (SELECT number FROM ({TRIALS}) WHERE state = 'COMPLETE' ORDER BY value DESC, number LIMIT 1) AS best_number FROM ({TRIALS})")
def g19(spark, sf):
    return reports.trial_summary(trials(spark, sf))


@query("SORT_best_trials", f"SELECT number, value FROM ({TRIALS}) ORDER BY value DESC NULLS LAST, number LIMIT 10")
def best_trials(spark, sf):
    return reports.best_trials(trials(spark, sf)).select("number", "value")


@query("G20_windowed_loss", f"SELECT epoch, step, round((loss * step - coalesce(lag(loss * step) OVER w, 0)) / (step - coalesce(lag(step) OVER w, 0)), 6) AS window_loss FROM ({STEPS}) WINDOW w AS (PARTITION BY epoch ORDER BY step)")
def g20(spark, sf):
    read(spark, sf, "events").createOrReplaceTempView("events")
    return reports.windowed_loss(spark.sql(STEPS)).select("epoch", "step", F.round("window_loss", 6).alias("window_loss"))


@query("G21_running_best", f"SELECT number, study, max(value) OVER (PARTITION BY study ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM ({TRIALS})")
def g21(spark, sf):
    return reports.running_best(trials(spark, sf)).select("number", "study", "best_so_far")


@query("SORT_best_epoch", "SELECT o_custkey AS epoch, o_totalprice AS val_loss FROM orders ORDER BY o_totalprice, o_custkey LIMIT 1")
def best_epoch(spark, sf):
    return reports.best_epoch(read(spark, sf, "orders").select(F.col("o_custkey").alias("epoch"), F.col("o_totalprice").alias("val_loss")))
