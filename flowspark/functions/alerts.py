"""Columns of an alert record and of the live event."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.labels import label_name
from flowspark.functions.scores import confidence, top_predictions, top_probability_map

INTEL_FIELDS = ["severity", "description", "mitre_tactics", "techniques", "zeek_indicators",
                "response_actions", "tags"]


def verdict(is_attack: Column, ground_truth: Column) -> Column:
    """TP / FP / FN / TN, null when the truth is unknown."""
    truth = ground_truth != 0
    return (
        F.when(ground_truth.isNull(), F.lit(None).cast("string"))
        .when(is_attack & truth, "TP")
        .when(is_attack, "FP")
        .when(truth, "FN")
        .otherwise("TN")
    )


def binary_truth(has_attack: Column) -> Column:
    """Truth stored with stream alerts: 1 when any flow of the session is an attack."""
    return F.when(has_attack, 1).otherwise(0).cast("int")


def alert_id(*key: Column) -> Column:
    """A hash that depends only on the key, so that a retried job repeats it; the alert table's key."""
    return F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256)


def short_id(alert_uuid: Column) -> Column:
    """Eight characters of an alert id to show; different alerts may share them."""
    return F.substring(alert_uuid, 1, 8)


def stream_alert_id(n: Column) -> Column:
    return F.concat(F.lit("stream-"), n.cast("string"))


def threat_intel(description: Column, severity, mitre_tactics, techniques, zeek_indicators, response_actions,
                 tags) -> Column:
    """Shortened knowledge-base fields that travel with an alert."""
    return F.struct(
        severity.alias("severity"),
        F.substring(description, 1, 400).alias("description"),
        mitre_tactics.alias("mitre_tactics"),
        F.slice(techniques, 1, 3).alias("techniques"),
        F.slice(zeek_indicators, 1, 3).alias("zeek_indicators"),
        F.slice(response_actions, 1, 3).alias("response_actions"),
        F.slice(tags, 1, 8).alias("tags"),
    )


def intel_from_kb() -> Column:
    """threat_intel over the knowledge-base columns of the current table; null for benign."""
    intel = threat_intel(*[F.col(c) for c in ["description", "severity", *INTEL_FIELDS[2:]]])
    return F.when(F.col("attack_id") != 0, intel)


def alert_fields(alert_uuid: Column, ts: Column, class_id: Column, probs: Column, n_flows: Column):
    """The scalar fields every alert carries, as named columns."""
    return [
        alert_uuid.alias("alert_uuid"),
        short_id(alert_uuid).alias("short_id"),
        ts.cast("double").alias("ts"),
        class_id.cast("int").alias("attack_id"),
        label_name(class_id, F.lit("Unknown")).alias("attack_name"),
        F.round(confidence(probs, class_id), 4).alias("confidence"),
        (class_id != 0).alias("is_attack"),
        n_flows.cast("int").alias("n_flows"),
        top_predictions(probs, 3).alias("top_predictions"),
    ]


def alert_json(columns, without=("threat_intelligence",)) -> Column:
    """The alert as JSON text without its bulky parts."""
    return F.to_json(F.struct(*[F.col(c) for c in columns if c not in without]))


def live_event(session_id, ts, config_used, class_id, conf, probs, majority_id, distribution) -> Column:
    """Nested record of one live detection."""
    return F.struct(
        F.lit("detection").alias("type"),
        session_id.alias("session_id"),
        ts.alias("timestamp"),
        config_used.alias("config_used"),
        F.struct(
            class_id.alias("id"),
            label_name(class_id).alias("name"),
            F.round(conf, 4).alias("confidence"),
            (class_id != 0).alias("is_attack"),
            top_probability_map(probs, 5).alias("top_probabilities"),
        ).alias("prediction"),
        F.struct(
            majority_id.alias("majority_id"),
            label_name(majority_id).alias("majority_name"),
            distribution.alias("distribution"),
        ).alias("ground_truth"),
        (class_id == majority_id).alias("correct"),
    )
