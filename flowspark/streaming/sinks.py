"""Where streams end: alert table, running counters, batch tables."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.alerts import binary_truth, stream_alert_id, verdict
from flowspark.operators.counters import detection_counters, throughput
from flowspark.sources import files
from flowspark.sources.alert_table import AlertTable
from flowspark.sources.stores import write_json


def start_counters(events: DataFrame, path, checkpoint, trigger=None):
    """Running counters of an event stream: one row per batch folder, which a repeated batch writes again."""

    def keep(counters, batch_id):
        counters.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        detection_counters(events).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_counters(spark, path) -> DataFrame:
    """The counters of the last batch that is complete; they outlive the query and its driver."""
    done = files.glob(spark, f"{path}/batch=*/_SUCCESS")
    if not done:
        raise FileNotFoundError(f"no counters in {path}")
    last = max(int(re.search(r"batch=(\d+)/_SUCCESS$", p).group(1)) for p in done)
    return spark.read.parquet(f"{path}/batch={last}")


def start_alerts(alerts: DataFrame, table: AlertTable, checkpoint, source="stream", trigger=None):
    """Upsert a stream of alerts; the checkpoint names the stream, so a repeated batch changes nothing."""
    return (
        alerts.writeStream.foreachBatch(lambda batch, batch_id: table.record(batch, source, batch_id, checkpoint))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def start_table(df: DataFrame, path, checkpoint, trigger=None):
    """Append a stream to a parquet table."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def session_alerts(scored: DataFrame, number="session_no") -> DataFrame:
    """Alert rows of scored sessions (attack_id, confidence, has_attack, n_flows, ts, number).

    The truth kept with them is 1 when the session has any attack flow.
    """
    truth = binary_truth(F.col("has_attack"))
    is_attack = F.col("attack_id") != 0
    return scored.select(
        stream_alert_id(F.col(number)).alias("alert_uuid"),
        F.col("ts").cast("double").alias("ts"),
        "attack_id", "attack_name", F.round("confidence", 4).alias("confidence"), is_attack.alias("is_attack"),
        F.lit("stream").alias("source"), F.col(number).cast("bigint").alias("session_id"),
        truth.alias("ground_truth"), verdict(is_attack, truth).alias("verdict"), "n_flows",
    )


def write_stream_summary(events: DataFrame, seconds, path):
    """Final counters of a run with its rate, as one JSON row."""
    write_json(throughput(detection_counters(events), seconds), path)
