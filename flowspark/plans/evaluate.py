"""Evaluation of fitted detectors over a session table."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.metrics import metrics_by
from flowspark.operators.sessions import sessionize
from flowspark.plans.prepare import session_prefixes, session_table
from flowspark.schema import ABLATION_SIZES, TRUNCATION_POINTS


def score_configs(detectors, sessions: DataFrame, label="label"):
    """Prediction rows of every configuration: config, y_true, y_pred, probs and the session columns."""
    parts = [
        detectors.predict(sessions, c).withColumn("y_true", F.col(label)) for c in detectors.models
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def latency_curve(score, aligned_session_flows: DataFrame, points=tuple(TRUNCATION_POINTS),
                  keys=("host", "session_idx")):
    """Accuracy and F1 by number of observed flows, statistics on raw values.

    score adds y_pred to a session table, whose observed_label is the label of the flows seen so
    far; the truth is the label of the whole session. Both come from one running pass over the flows.
    """
    cut = session_prefixes(aligned_session_flows, points, list(keys))
    return metrics_by(score(cut.withColumnRenamed("label", "y_true")), "n_flows")


def window_ablation(score, aligned: DataFrame, sizes=tuple(ABLATION_SIZES), **options):
    """Accuracy and F1 by window size, windows cut anew for every size."""
    parts = []
    for size in sizes:
        table = session_table(sessionize(aligned, size, **options))
        parts.append(score(table.withColumn("y_true", F.col("label"))).select("y_true", "y_pred", F.lit(size).alias("size")))
    return metrics_by(reduce(DataFrame.unionByName, parts), "size")
