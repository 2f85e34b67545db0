"""Request path: rows of flow arrays in, alerts out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.errors import ModelNotLoadedError
from flowspark.functions.alerts import alert_fields, alert_id
from flowspark.functions.alignment import protocol_sql, width_checked_sql
from flowspark.functions.cleaning import clean_sql
from flowspark.operators.quality import fits_request, log_type_counts, present_log_types
from flowspark.operators.stats import session_stats, stat_inputs
from flowspark.operators.threat import add_threat_intel
from flowspark.schema import FEATURES, MAX_FLOWS_PER_REQUEST, PROTOCOL_COLUMNS, STAT_NAMES, TRAINED_FEATURES
from flowspark.session import materialise


#: Raw columns that the protocol columns are made from.
_PROTOCOL_INPUTS = ("destination_port", "total_backward_packets", "fin_flag_count", "syn_flag_count", "rst_flag_count")


def aligned_requests(requests: DataFrame, columns=tuple(TRAINED_FEATURES)) -> DataFrame:
    """(request_id, pos, features[78], log_type) to the trained columns asked for, boundary-cleaned.

    Every row's width is checked, but only values that are asked for are cleaned: cleaning all of them takes most of the
    time of a row.
    """
    made = any(c in columns for c in PROTOCOL_COLUMNS if c != "log_type")
    raw = [c for c in FEATURES if c in columns or made and c in _PROTOCOL_INPUTS]
    taken = ", ".join(f"_f[{FEATURES.index(c)}]" for c in raw)

    def at(name):
        return f"_c[{raw.index(name)}]"

    protocol = protocol_sql(at, "log_type") if made else {"log_type": "log_type"}
    cells = {c: f"CAST({protocol[c]} AS DOUBLE)" if c in protocol else at(c) for c in TRAINED_FEATURES if c in columns}
    checked = width_checked_sql("_f", f"transform(array({taken}), v -> {clean_sql('v', 'bound')})")
    rows = requests.withColumn("_f", F.expr("CAST(features AS ARRAY<DOUBLE>)")).withColumn("_c", F.expr(checked))
    return rows.selectExpr("request_id", "pos", "features AS _given", *[f"{e} AS `{c}`" for c, e in cells.items()])


def analyze(requests: DataFrame, detectors, embedder, received_at, max_flows=MAX_FLOWS_PER_REQUEST):
    """(alerts, rejected requests).

    A request without flows or with more than max_flows is rejected. Others are scored by C, else
    B. received_at is the epoch time stamped on the alerts, so that a retried job repeats itself.
    """
    if detectors is None or embedder is None:
        raise ModelNotLoadedError("detector models")
    # flows, statistics, summary and log types of a request come from one aggregate; a row a request is left
    extra = [F.count("_given").cast("int").alias("n_flows"), *embedder.aggregates(embedder.scaler), *log_type_counts()]
    read = {"log_type", *stat_inputs(TRAINED_FEATURES), *embedder.scaler.columns}
    table = materialise(session_stats(aligned_requests(requests, read), ["request_id"], extra, bounded=False), "requests")
    fits = fits_request(F.col("n_flows"), max_flows)
    rejected = table.filter(~fits).select("request_id", F.col("n_flows").cast("bigint").alias("n_flows"))
    accepted = table.filter(fits).withColumn("log_type_distribution", present_log_types())
    scored = detectors.predict_with_fallback(embedder.embed(accepted))
    stat_map = F.create_map(*[x for s in STAT_NAMES for x in (F.lit(s), F.round(F.col(s), 4))])
    alerts = scored.select(
        "request_id",
        *alert_fields(alert_id(F.col("request_id")), F.lit(received_at), F.col("y_pred"), F.col("probs"), F.col("n_flows")),
        "config_used", stat_map.alias("session_stats"), "log_type_distribution",
    )
    return add_threat_intel(alerts), rejected
