"""Queries that run the streaming path over the event table until it is used up."""

import numpy as np
from pyspark.sql import functions as F

from flowspark.catalog.adapters import (
    ENRICHED_CTE, FLOW_COLUMNS, FLOWS_CTE, enriched, flows, flows_from_events, sessions_cte, table,
)
from flowspark.catalog.session_queries import KEYS, LABELLED_CTE, rounded_stats, stats_sql
from flowspark.functions.labels import label_name
from flowspark.functions.protocol import add_protocol_columns
from flowspark.operators.counters import attack_counts
from flowspark.operators.ordering import HOT_ROWS, PART_ROWS
from flowspark.operators.scaling import FeatureScaler
from flowspark.operators.sessions import session_summary
from flowspark.operators.stats import session_stats
from flowspark.schema import FEATURES, LABELS, N_CLASSES
from flowspark.session import work_dir
from flowspark.sources.alert_table import AlertTable
from flowspark.streaming.replay import clean_stream, detection_events, feature_events, score_stream, stream_parquet
from flowspark.streaming.sessions import split_valid_sessions, start_sessions
from flowspark.streaming.sinks import read_counters, session_alerts, start_alerts, start_counters, start_table


def _stream(spark, sf_dir):
    """The event table read as a stream of flows."""
    schema = table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1).parquet(sf_dir)
    )
    return add_protocol_columns(flows_from_events(events))


def _called(df):
    """A rule as a stand-in for a model: many SYN flags and short flows are a flood."""
    y_pred = F.when((F.col("syn_flag_count") > 0) & (F.col("flow_duration") < 100000), 4).otherwise(0)
    probs = F.array(*[F.when(y_pred == c, 0.9).otherwise(0.1 / (N_CLASSES - 1)) for c in range(N_CLASSES)])
    return df.withColumns({"y_pred": y_pred, "probs": probs})


def stream_counters(spark, sf_dir):
    events = detection_events(_called(_stream(spark, sf_dir)))
    root = work_dir(spark, "counters")
    start_counters(events, f"{root}/counters", f"{root}/checkpoint").awaitTermination()
    return read_counters(spark, f"{root}/counters").withColumns(
        {c: F.round(c, 6) for c in ("detection_rate", "false_positive_rate")})


def stream_events(spark, sf_dir):
    """Scored events of the stream, written as a table."""
    root = work_dir(spark, "events")
    start_table(detection_events(_called(_stream(spark, sf_dir))), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table").select(
        "flow_id", "attack_id", "attack_name", F.round("confidence", 6).alias("confidence"), "is_attack", "score_failed",
        "ground_truth_id", "ground_truth_name", "correct",
    )


def stream_features(spark, sf_dir):
    """The pass without a model."""
    root = work_dir(spark, "features")
    start_table(feature_events(_stream(spark, sf_dir)), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table").select("flow_id", "attack_id", "attack_name", "confidence", "ground_truth_id", "correct")


def _streamed_sessions(spark, sf_dir):
    root = work_dir(spark, "sessions")
    start_sessions(_stream(spark, sf_dir), f"{root}/windows", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/windows")


def _resumed_sessions(spark, sf_dir):
    """Windows of a stream of four slices in time, one a batch, that is stopped and started again half-way.

    A slice lies in files by host, so that its files may arrive in any order. There are more slices where a host
    has more than HOT_ROWS rows in one, as a task takes them all.
    """
    root = work_dir(spark, "resumed")
    events = table(spark, sf_dir, "events")
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    per_host = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_host.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    n_slices = 4 * max(1, -(-sizes["largest"] // (4 * HOT_ROWS)))
    n_files = max(1, -(-sizes["rows"] // (n_slices * PART_ROWS)))
    grid = [i / n_slices for i in range(1, n_slices)]
    cuts = events.agg(F.percentile_approx(second, grid, max(1000, 10 * n_slices)).alias("cuts")).first()["cuts"] or []
    edges = [None, *cuts, None]

    def arrive(slices):
        for low, high in slices:
            part = events.where(F.lit(low is None) | (second >= F.lit(low)))
            part = part.where(F.lit(high is None) | (second < F.lit(high)))
            part.repartition(n_files, "user_id").write.mode("append").parquet(f"{root}/arriving")

    def run():
        stream = add_protocol_columns(flows_from_events(stream_parquet(spark, f"{root}/arriving", events.schema, n_files)))
        start_sessions(stream, f"{root}/windows", f"{root}/checkpoint").awaitTermination()

    slices = list(zip(edges, edges[1:]))
    arrive(slices[:n_slices // 2])
    run()
    arrive(slices[n_slices // 2:])
    run()
    return spark.read.parquet(f"{root}/windows")


def stream_sessions(spark, sf_dir):
    """Windows cut by the stream: labels equal to those of the batch path."""
    return session_summary(_streamed_sessions(spark, sf_dir), KEYS).withColumn(
        "attack_ids", F.array_join(F.transform("attack_ids", lambda c: c.cast("string")), ",")
    )


def stream_sessions_resumed(spark, sf_dir):
    """The same labels from several files and two runs over one checkpoint."""
    return session_summary(_resumed_sessions(spark, sf_dir), KEYS).withColumn(
        "attack_ids", F.array_join(F.transform("attack_ids", lambda c: c.cast("string")), ",")
    )


def stream_stats(spark, sf_dir):
    return session_stats(_streamed_sessions(spark, sf_dir), KEYS).select(*KEYS, *rounded_stats())


def stream_alerts(spark, sf_dir):
    """Alerts of the stream recorded in the alert table, numbered by time."""
    root = work_dir(spark, "alerts")
    events = detection_events(_called(_stream(spark, sf_dir)))
    alerts = events.select(
        F.col("flow_id").alias("session_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "attack_id",
        "attack_name", "confidence", (F.col("ground_truth_id") != 0).alias("has_attack"), F.lit(20).alias("n_flows"),
    ).withColumn("ts", F.col("us") / 1e6)
    store = AlertTable(spark, f"{root}/table")
    start_alerts(session_alerts(alerts), store, f"{root}/checkpoint").awaitTermination()
    return store.numbered().select("seq", "alert_uuid", "attack_id", "verdict", "ground_truth", "source")


def model_fn_events(spark, sf_dir):
    """A user's function over raw and scaled arrays, batch by batch; it refuses NaN."""
    rows = clean_stream(flows(spark, sf_dir))
    scaler = FeatureScaler.fit(rows, FEATURES)
    duration, syn = FEATURES.index("flow_duration"), FEATURES.index("syn_flag_count")

    def rule(raw, scaled):
        if not np.isfinite(scaled).all():
            raise ValueError("not finite")
        called = np.where((raw[:, syn] > 0) & (raw[:, duration] < 100000), 4, 0)
        probs = np.full((len(raw), N_CLASSES), 0.1 / (N_CLASSES - 1))
        probs[np.arange(len(raw)), called] = 0.9
        return called, probs

    found = score_stream(rows, model_fn=rule, scaler=scaler)
    return found.select("flow_id", "attack_id", "attack_name", F.round("confidence", 6).alias("confidence"), "is_attack",
                        "score_failed", "ground_truth_id", "ground_truth_name", "correct")


def failed_batches(spark, sf_dir):
    """Every batch fails: all rows fall back to benign and are marked."""
    rows = clean_stream(flows(spark, sf_dir))
    scaler = FeatureScaler.fit(rows, FLOW_COLUMNS + [c for c in FEATURES if c not in FLOW_COLUMNS])

    def broken(raw, scaled):
        raise RuntimeError("no model")

    found = score_stream(rows, model_fn=broken, scaler=scaler)
    return found.groupBy("attack_id", "attack_name", "confidence", "score_failed").agg(F.count("*").alias("n"))


def stream_attacks(spark, sf_dir):
    events = detection_events(_called(enriched(spark, sf_dir)))
    return attack_counts(events)


def quarantine(spark, sf_dir):
    """Daily groups of a host fit to be scored and the others with the reason."""
    rows = enriched(spark, sf_dir).withColumn("session_idx", F.date_format("ts", "yyyy-MM-dd"))
    rows = rows.withColumn("flow_duration", F.when(F.col("flow_id") % 97 != 0, F.col("flow_duration")))
    valid, failed = split_valid_sessions(rows, FLOW_COLUMNS, 2, ["host", "session_idx"])
    good = valid.groupBy("host", "session_idx").agg(F.count("*").alias("n_flows")).withColumn("reason", F.lit("none"))
    return good.unionByName(failed.select("host", "session_idx", "n_flows", "reason"))


def replay_names(spark, sf_dir):
    """Label names of streamed truth."""
    events = detection_events(_called(enriched(spark, sf_dir)))
    return events.groupBy("ground_truth_name", label_name(F.col("ground_truth_id")).alias("decoded")).agg(F.count("*").alias("n"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in LABELS.values()) + "]"
_CALLED = f"""
WITH {FLOWS_CTE},
called AS (SELECT *, CASE WHEN syn_flag_count > 0 AND flow_duration < 100000 THEN 4 ELSE 0 END AS c FROM flows)"""
_EVENTS = f"""{_CALLED}
SELECT flow_id, CAST(c AS INT) AS attack_id, {_NAMES}[c + 1] AS attack_name, 0.9e0 AS confidence, c <> 0 AS is_attack,
  false AS score_failed, label_id AS ground_truth_id, {_NAMES}[label_id + 1] AS ground_truth_name, c = label_id AS correct FROM called"""

_SESSIONS = f"""
WITH {ENRICHED_CTE}{sessions_cte()}{LABELLED_CTE}
SELECT host, session_idx, label, has_attack, attack_ids, n_flows FROM labelled"""

QUERIES = {
    "stream_counters": (stream_counters, f"""{_CALLED},
s AS (SELECT count(*) AS total_flows, count(*) FILTER (label_id <> 0) AS total_attacks, count(*) FILTER (label_id = 0) AS total_benign,
  count(*) FILTER (label_id <> 0 AND c <> 0) AS tp, count(*) FILTER (label_id = 0 AND c <> 0) AS fp,
  count(*) FILTER (label_id <> 0 AND c = 0) AS fn, count(*) FILTER (label_id = 0 AND c = 0) AS tn FROM called)
SELECT *, round(tp / CAST(tp + fn AS DOUBLE), 6) AS detection_rate, round(fp / CAST(fp + tn AS DOUBLE), 6) AS false_positive_rate FROM s"""),
    "stream_events": (stream_events, _EVENTS),
    "stream_features": (stream_features, f"""
WITH {FLOWS_CTE}
SELECT flow_id, CAST(-1 AS INT) AS attack_id, '' AS attack_name, 0e0 AS confidence, label_id AS ground_truth_id,
  CAST(NULL AS BOOLEAN) AS correct FROM flows"""),
    "stream_sessions": (stream_sessions, _SESSIONS),
    "stream_sessions_resumed": (stream_sessions_resumed, _SESSIONS),
    "stream_stats": (stream_stats, f"WITH {ENRICHED_CTE}{sessions_cte()}\n{stats_sql()}"),
    "stream_alerts": (stream_alerts, f"""{_CALLED},
k AS (SELECT *, row_number() OVER (ORDER BY ts, 'stream-' || flow_id) AS seq FROM called)
SELECT seq, 'stream-' || flow_id AS alert_uuid, CAST(c AS INT) AS attack_id,
  CASE WHEN c <> 0 AND label_id <> 0 THEN 'TP' WHEN c <> 0 THEN 'FP' WHEN label_id <> 0 THEN 'FN' ELSE 'TN' END AS verdict,
  CAST(label_id <> 0 AS INT) AS ground_truth, 'stream' AS source FROM k"""),
    "model_fn_events": (model_fn_events, _EVENTS),
    "failed_batches": (failed_batches, """
SELECT CAST(0 AS INT) AS attack_id, 'BENIGN' AS attack_name, 1e0 AS confidence, true AS score_failed, count(*) AS n FROM events"""),
    "attack_counts_by_rule": (stream_attacks, f"""{_CALLED}
SELECT {_NAMES}[c + 1] AS attack_name, count(*) AS n FROM called WHERE c <> 0 GROUP BY 1"""),
    "session_quarantine": (quarantine, f"""
WITH {FLOWS_CTE},
g AS (SELECT host, strftime(ts, '%Y-%m-%d') AS session_idx, count(*) AS n_flows, bool_or(flow_id % 97 = 0) AS bad FROM flows GROUP BY 1, 2)
SELECT host, session_idx, n_flows, CASE WHEN n_flows <> 2 THEN 'session size' WHEN bad THEN 'NaN or infinite value' ELSE 'none' END AS reason
FROM g"""),
    "replay_names": (replay_names, f"""
WITH {FLOWS_CTE}
SELECT {_NAMES}[label_id + 1] AS ground_truth_name, {_NAMES}[label_id + 1] AS decoded, count(*) AS n FROM flows GROUP BY 1, 2"""),
}
