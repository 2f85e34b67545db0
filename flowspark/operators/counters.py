"""Roll-ups of detections and alerts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.labels import label_name
from flowspark.schema import ALERT_ORDER


def detection_counters(events: DataFrame, truth="ground_truth_id", pred="attack_id", by=()):
    """Per-flow counters; rows without truth count by their prediction. One aggregate, any output mode."""
    known = F.col(truth).isNotNull()
    is_attack, call = F.col(truth) != 0, F.col(pred) != 0
    counted = events.groupBy(*by).agg(
        F.count("*").alias("total_flows"),
        F.count_if((known & is_attack) | (~known & call)).alias("total_attacks"),
        F.count_if((known & ~is_attack) | (~known & ~call)).alias("total_benign"),
        F.count_if(known & is_attack & call).alias("tp"),
        F.count_if(known & ~is_attack & call).alias("fp"),
        F.count_if(known & is_attack & ~call).alias("fn"),
        F.count_if(known & ~is_attack & ~call).alias("tn"),
    )
    return counted.withColumns(_rates())


def attack_counts(events: DataFrame, pred="attack_id"):
    """Detections per attack class."""
    called = events.filter(F.col(pred) != 0)
    return called.groupBy(label_name(F.col(pred)).alias("attack_name")).agg(F.count("*").alias("n"))


def session_counters(events: DataFrame, session_size):
    """Live per-session snapshot from (pred_id, majority_id, has_attack): binary and class accuracy, rates."""
    truth, call = F.col("has_attack"), F.col("pred_id") != 0
    counted = events.agg(
        F.count("*").alias("total_sessions"),
        (F.count("*") * session_size).alias("total_flows"),
        F.count_if(F.col("pred_id") == F.col("majority_id")).alias("correct"),
        F.count_if(truth & call).alias("tp"), F.count_if(~truth & call).alias("fp"),
        F.count_if(truth & ~call).alias("fn"), F.count_if(~truth & ~call).alias("tn"),
    )
    total = F.col("total_sessions")
    return counted.withColumns({
        "accuracy": F.round(_share(F.col("tp") + F.col("tn"), total), 4),
        "multiclass_accuracy": F.round(_share(F.col("correct"), total), 4),
        **_rates(4),
    })


def throughput(counters: DataFrame, seconds):
    """Counters with rows per second over an elapsed time the caller measured."""
    rate = F.round(F.col("total_flows") / F.lit(float(seconds)), 1) if seconds > 0 else F.lit(0.0)
    return counters.withColumn("flows_per_second", rate)


def _rates(digits=None):
    recall = _share(F.col("tp"), F.col("tp") + F.col("fn"))
    fpr = _share(F.col("fp"), F.col("fp") + F.col("tn"))
    if digits is not None:
        recall, fpr = F.round(recall, digits), F.round(fpr, digits)
    return {"detection_rate": recall, "false_positive_rate": fpr}


def _share(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


# ---- alert table -----------------------------------------------------------------------------------

def recent_alerts(alerts: DataFrame, limit=50, source=None):
    """Newest alerts first."""
    if source is not None:
        alerts = alerts.filter(F.col("source") == source)
    return alerts.orderBy(*[F.desc_nulls_last(c) for c in ALERT_ORDER]).limit(limit).select(
        "alert_uuid", "ts", "attack_id", "attack_name", "confidence", "is_attack", "source", "session_id", "verdict"
    )


def alert_totals(alerts: DataFrame):
    """One row: alerts, attacks, the attacks' share and the verdict counts."""
    return alerts.agg(
        F.count("*").alias("total_sessions_analyzed"),
        F.count_if(F.col("is_attack")).alias("total_attacks_detected"),
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("TP", "FP", "TN", "FN")],
    ).withColumn("attack_share", F.round(
        F.col("total_attacks_detected") / F.greatest("total_sessions_analyzed", F.lit(1)), 4
    ))


def alerts_by_attack(alerts: DataFrame):
    return alerts.filter("is_attack").groupBy("attack_name").agg(F.count("*").alias("n"))


def alerts_by_source(alerts: DataFrame):
    return alerts.groupBy("source").agg(F.count("*").alias("n"))


def top_attacks(counts: DataFrame, n=10):
    """Most frequent attacks first, ties by name."""
    return counts.orderBy(F.col("n").desc(), "attack_name").limit(n)


def attack_bars(counts: DataFrame):
    """Counts with their length relative to the longest bar; at most one row per class."""
    top = F.max("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("bar_percent", F.round(F.col("n") * 100 / top, 1))
