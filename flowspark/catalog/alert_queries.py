"""Queries over the alert table and running counters."""

from pyspark.sql import functions as F

from flowspark.catalog.adapters import ENRICHED_CTE, PREDICTIONS_CTE, predictions, sessions_cte
from flowspark.catalog.session_queries import KEYS, windows
from flowspark.functions.alerts import alert_fields, alert_id, alert_json, binary_truth, live_event, verdict
from flowspark.functions.labels import label_name
from flowspark.functions.scores import confidence
from flowspark.functions.text import kpi_band
from flowspark.operators import counters as C
from flowspark.operators.sessions import session_truth
from flowspark.schema import LABELS
from flowspark.session import work_dir
from flowspark.sources.alert_table import AlertTable, newest_per_id, normalise_alerts, retain

_NAMES = "[" + ", ".join(f"'{n}'" for n in LABELS.values()) + "]"


def alerts_of(spark, sf_dir):
    """Predictions as alerts: two sources, three detections share an id, every fifth truth unknown."""
    preds = predictions(spark, sf_dir)
    n = F.col("session_id")
    rows = preds.select(
        F.concat(F.lit("a"), F.floor(n / 3).cast("string")).alias("alert_uuid"),
        (n.cast("double") + 1700000000).alias("ts"), F.col("y_pred").alias("attack_id"),
        label_name(F.col("y_pred")).alias("attack_name"),
        F.round(confidence(F.col("probs"), F.col("y_pred")), 4).alias("confidence"),
        (F.col("y_pred") != 0).alias("is_attack"),
        F.when(n % 4 == 0, "rest").otherwise("stream").alias("source"), n.alias("session_id"),
        F.when(n % 5 != 0, F.col("y_true")).alias("ground_truth"), F.lit(20).alias("n_flows"),
    )
    return normalise_alerts(rows)


def stored(spark, sf_dir):
    """The alert table after recording all alerts in one batch."""
    store = AlertTable(spark, work_dir(spark, "alert-table"))
    store.record(alerts_of(spark, sf_dir))
    return store.read()


def verdicts(spark, sf_dir):
    return alerts_of(spark, sf_dir).select("session_id", "ground_truth", "verdict")


def one_per_id(spark, sf_dir):
    """The last alert of each id over all alerts, before the table's size limit."""
    found = newest_per_id(alerts_of(spark, sf_dir), ("ts",))
    return found.select("alert_uuid", "session_id", "ts", "attack_id", "verdict")


def upserted(spark, sf_dir):
    """The table after three batches, the later ones updating ids of the earlier."""
    alerts = alerts_of(spark, sf_dir)
    store = AlertTable(spark, work_dir(spark, "alert-table"))
    store.record(alerts.filter("session_id % 3 = 0"))
    store.record(alerts.filter("session_id % 3 = 2").withColumn("ts", F.col("ts") + 1e6))
    store.record(alerts.filter("session_id % 3 = 1").withColumn("ts", F.col("ts") + 2e6))
    return store.read().select("alert_uuid", "session_id", "ts", "attack_id", "verdict")


def recent(spark, sf_dir):
    return C.recent_alerts(stored(spark, sf_dir), 50).drop("ts")


def recent_rest(spark, sf_dir):
    return C.recent_alerts(stored(spark, sf_dir), 50, "rest").drop("ts")


def totals(spark, sf_dir):
    return C.alert_totals(stored(spark, sf_dir))


def by_attack(spark, sf_dir):
    return C.alerts_by_attack(stored(spark, sf_dir))


def by_source(spark, sf_dir):
    return C.alerts_by_source(stored(spark, sf_dir))


def top_attacks(spark, sf_dir):
    return C.top_attacks(C.alerts_by_attack(stored(spark, sf_dir)), 10)


def bars(spark, sf_dir):
    return C.attack_bars(C.alerts_by_attack(stored(spark, sf_dir)))


def retention(spark, sf_dir):
    """Newest 1000 by sequence of the whole table."""
    return retain(stored(spark, sf_dir), 1000).select("alert_uuid", "session_id")


def flow_counters(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    truth = F.when(F.col("session_id") % 5 != 0, F.col("y_true"))
    found = C.detection_counters(preds.withColumn("ground_truth_id", truth), pred="y_pred")
    return found.withColumns({c: F.round(c, 6) for c in ("detection_rate", "false_positive_rate")})


def called_attacks(spark, sf_dir):
    return C.attack_counts(predictions(spark, sf_dir), "y_pred")


def session_calls(spark, sf_dir):
    """Sessions with live truth, called attack when flows with a SYN are many."""
    flows = windows(spark, sf_dir)
    syn = flows.groupBy(*KEYS).agg(F.sum("syn_flag_count").alias("syn"), F.max("ts").alias("last_ts"))
    return session_truth(flows).join(syn, KEYS).withColumn("pred_id", F.when(F.col("syn") > 10, 4).otherwise(0))


def live_counters(spark, sf_dir):
    found = C.session_counters(session_calls(spark, sf_dir), 20)
    return found.withColumn("band", kpi_band(F.col("accuracy")))


def stream_truth(spark, sf_dir):
    calls = session_calls(spark, sf_dir)
    truth = binary_truth(F.col("has_attack"))
    return calls.select(*KEYS, truth.alias("ground_truth"), verdict(F.col("pred_id") != 0, truth).alias("verdict"))


def alert_records(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    fields = alert_fields(alert_id(F.col("session_id")), F.col("session_id") + 1700000000, F.col("y_pred"), F.col("probs"), F.lit(20))
    rows = preds.select("session_id", *fields)
    tops = F.transform("top_predictions", lambda t: t["attack_id"].cast("string"))
    return rows.withColumn("top_predictions", F.array_join(tops, ","))


def alert_text(spark, sf_dir):
    """JSON text of alerts without the intel part, read back field by field."""
    rows = alerts_of(spark, sf_dir).withColumn("threat_intelligence", F.lit("long text"))
    text = alert_json(["alert_uuid", "attack_id", "attack_name", "is_attack", "threat_intelligence"])
    rows = rows.select("session_id", text.alias("j"))
    return rows.select(
        "session_id", F.get_json_object("j", "$.alert_uuid").alias("alert_uuid"),
        F.get_json_object("j", "$.attack_id").cast("int").alias("attack_id"),
        F.get_json_object("j", "$.attack_name").alias("attack_name"),
        F.get_json_object("j", "$.threat_intelligence").isNull().alias("intel_left_out"),
    )


def live_events(spark, sf_dir):
    """Nested live events as JSON, read back field by field."""
    preds = predictions(spark, sf_dir)
    event = live_event(
        F.col("session_id"), F.col("session_id") + F.lit(0.5), F.lit("C"), F.col("y_pred"),
        confidence(F.col("probs"), F.col("y_pred")), F.col("probs"), F.col("y_true"),
        F.create_map(label_name(F.col("y_true")), F.lit(20)),
    )
    rows = preds.select("session_id", F.to_json(event).alias("j"))

    def at(path):
        return F.get_json_object("j", f"$.{path}")

    return rows.select(
        "session_id", at("type").alias("type"), at("prediction.name").alias("name"),
        at("prediction.is_attack").cast("boolean").alias("is_attack"),
        F.round(at("prediction.confidence").cast("double"), 4).alias("confidence"),
        at("ground_truth.majority_name").alias("majority_name"), at("correct").cast("boolean").alias("correct"),
        F.size(F.json_object_keys(at("prediction.top_probabilities"))).cast("bigint").alias("n_top"),
    )


_P = f"WITH {PREDICTIONS_CTE}"
_ALERTS = f"""{_P},
alerts AS (
  SELECT 'a' || (session_id // 3) AS alert_uuid, session_id + 1700000000e0 AS ts, y_pred AS attack_id,
    {_NAMES}[y_pred + 1] AS attack_name, round(probs[y_pred + 1], 4) AS confidence, y_pred <> 0 AS is_attack,
    CASE WHEN session_id % 4 = 0 THEN 'rest' ELSE 'stream' END AS source, session_id,
    CASE WHEN session_id % 5 <> 0 THEN y_true END AS ground_truth
  FROM preds
),
judged AS (
  SELECT *, CASE WHEN ground_truth IS NULL THEN NULL
    WHEN is_attack AND ground_truth <> 0 THEN 'TP' WHEN is_attack THEN 'FP'
    WHEN ground_truth <> 0 THEN 'FN' ELSE 'TN' END AS verdict FROM alerts
),
latest AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY alert_uuid ORDER BY ts DESC) = 1)"""
_RECENT = "SELECT alert_uuid, attack_id, attack_name, confidence, is_attack, source, session_id, verdict FROM latest"

_CALLS = f"""
WITH {ENRICHED_CTE}{sessions_cte()},
c AS (SELECT host, session_idx, label_id, count(*) AS n, min(pos) AS first_pos, sum(syn_flag_count) AS syn
      FROM session_flows GROUP BY ALL),
calls AS (
  SELECT host, session_idx, arg_max(label_id, n * 1000 - first_pos) AS majority_id, bool_or(label_id <> 0) AS has_attack,
    CASE WHEN sum(syn) > 10 THEN 4 ELSE 0 END AS pred_id FROM c GROUP BY ALL
)"""

QUERIES = {
    "verdicts": (verdicts, f"{_ALERTS}\nSELECT session_id, ground_truth, verdict FROM judged"),
    "alert_dedup": (one_per_id, f"{_ALERTS}\nSELECT alert_uuid, session_id, ts, attack_id, verdict FROM latest"),
    "alert_upsert": (upserted, f"""{_ALERTS},
again AS (SELECT * REPLACE (ts + CASE session_id % 3 WHEN 1 THEN 2e6 WHEN 2 THEN 1e6 ELSE 0e0 END AS ts) FROM judged),
one AS (SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY alert_uuid ORDER BY ts DESC) = 1)
SELECT alert_uuid, session_id, ts, attack_id, verdict FROM one"""),
    "alert_recent": (recent, f"{_ALERTS}\n{_RECENT} ORDER BY ts DESC LIMIT 50"),
    "alert_recent_source": (recent_rest, f"{_ALERTS}\n{_RECENT} WHERE source = 'rest' ORDER BY ts DESC LIMIT 50"),
    "alert_stats": (totals, f"""{_ALERTS}
SELECT count(*) AS total_sessions_analyzed, count(*) FILTER (is_attack) AS total_attacks_detected,
  count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp, count(*) FILTER (verdict = 'TN') AS tn,
  count(*) FILTER (verdict = 'FN') AS fn,
  round(count(*) FILTER (is_attack) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS attack_share FROM latest"""),
    "alerts_by_attack": (by_attack, f"{_ALERTS}\nSELECT attack_name, count(*) AS n FROM latest WHERE is_attack GROUP BY 1"),
    "alerts_by_source": (by_source, f"{_ALERTS}\nSELECT source, count(*) AS n FROM latest GROUP BY 1"),
    "alert_top_attacks": (top_attacks, f"""{_ALERTS}
SELECT attack_name, count(*) AS n FROM latest WHERE is_attack GROUP BY 1 ORDER BY n DESC, attack_name LIMIT 10"""),
    "alert_bars": (bars, f"""{_ALERTS}, b AS (SELECT attack_name, count(*) AS n FROM latest WHERE is_attack GROUP BY 1)
SELECT attack_name, n, round(n * 100 / CAST(max(n) OVER () AS DOUBLE), 1) AS bar_percent FROM b"""),
    "alert_retention": (retention, f"{_ALERTS}\nSELECT alert_uuid, session_id FROM latest ORDER BY ts DESC LIMIT 1000"),
    "alert_record": (alert_records, f"""{_P},
e AS (SELECT session_id, unnest(probs) AS p, unnest(range(15)) AS c FROM preds),
t AS (SELECT session_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY p DESC, c) AS top_predictions FROM
  (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY p DESC, c) <= 3) GROUP BY 1)
SELECT session_id, sha256(CAST(session_id AS VARCHAR)) AS alert_uuid,
  substr(sha256(CAST(session_id AS VARCHAR)), 1, 8) AS short_id, session_id + 1700000000e0 AS ts,
  y_pred AS attack_id, {_NAMES}[y_pred + 1] AS attack_name, round(probs[y_pred + 1], 4) AS confidence,
  y_pred <> 0 AS is_attack, CAST(20 AS INT) AS n_flows, top_predictions FROM preds JOIN t USING (session_id)"""),
    "alert_json": (alert_text, f"{_ALERTS}\nSELECT session_id, alert_uuid, attack_id, attack_name, true AS intel_left_out FROM alerts"),
    "live_event": (live_events, f"""{_P}
SELECT session_id, 'detection' AS type, {_NAMES}[y_pred + 1] AS name, y_pred <> 0 AS is_attack,
  round(probs[y_pred + 1], 4) AS confidence, {_NAMES}[y_true + 1] AS majority_name, y_pred = y_true AS correct,
  CAST(5 AS BIGINT) AS n_top FROM preds"""),
    "flow_counters": (flow_counters, f"""{_P},
g AS (SELECT y_pred, CASE WHEN session_id % 5 <> 0 THEN y_true END AS t FROM preds),
s AS (SELECT count(*) AS total_flows, count(*) FILTER (coalesce(t, y_pred) <> 0) AS total_attacks,
  count(*) FILTER (coalesce(t, y_pred) = 0) AS total_benign, count(*) FILTER (t <> 0 AND y_pred <> 0) AS tp,
  count(*) FILTER (t = 0 AND y_pred <> 0) AS fp, count(*) FILTER (t <> 0 AND y_pred = 0) AS fn,
  count(*) FILTER (t = 0 AND y_pred = 0) AS tn FROM g)
SELECT *, round(tp / CAST(tp + fn AS DOUBLE), 6) AS detection_rate, round(fp / CAST(fp + tn AS DOUBLE), 6) AS false_positive_rate FROM s"""),
    "attack_counts": (called_attacks, f"""{_P}
SELECT {_NAMES}[y_pred + 1] AS attack_name, count(*) AS n FROM preds WHERE y_pred <> 0 GROUP BY 1"""),
    "session_counters": (live_counters, f"""{_CALLS},
s AS (SELECT count(*) AS total_sessions, count(*) * 20 AS total_flows, count(*) FILTER (pred_id = majority_id) AS correct,
  count(*) FILTER (has_attack AND pred_id <> 0) AS tp, count(*) FILTER (NOT has_attack AND pred_id <> 0) AS fp,
  count(*) FILTER (has_attack AND pred_id = 0) AS fn, count(*) FILTER (NOT has_attack AND pred_id = 0) AS tn FROM calls),
r AS (SELECT *, round((tp + tn) / CAST(total_sessions AS DOUBLE), 4) AS accuracy,
  round(correct / CAST(total_sessions AS DOUBLE), 4) AS multiclass_accuracy, round(tp / CAST(tp + fn AS DOUBLE), 4) AS detection_rate,
  round(fp / CAST(fp + tn AS DOUBLE), 4) AS false_positive_rate FROM s)
SELECT *, CASE WHEN accuracy >= 0.9 THEN 'green' WHEN accuracy >= 0.7 THEN 'yellow' ELSE 'red' END AS band FROM r"""),
    "stream_truth": (stream_truth, f"""{_CALLS}
SELECT host, session_idx, CAST(has_attack AS INT) AS ground_truth,
  CASE WHEN pred_id <> 0 AND has_attack THEN 'TP' WHEN pred_id <> 0 THEN 'FP' WHEN has_attack THEN 'FN' ELSE 'TN' END AS verdict
FROM calls"""),
}
