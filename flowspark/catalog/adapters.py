"""The driver's tables seen as flows, sessions and predictions, once for Spark and once as SQL."""

from pyspark.sql import DataFrame

from flowspark.functions.protocol import add_protocol_columns
from flowspark.schema import N_CLASSES

FLOW_COLUMNS = [
    "destination_port", "flow_duration", "total_fwd_packets", "total_backward_packets",
    "total_length_of_fwd_packets", "total_length_of_bwd_packets", "flow_bytes_s", "flow_iat_mean",
    "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count", "urg_flag_count",
    "init_win_bytes_forward", "init_win_bytes_backward", "active_mean", "idle_mean",
]

PORTS = [53, 80, 443, 21, 22, 25, 8080, 8443, 3306]


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark, sf_dir) -> DataFrame:
    """events as flows: ids, 17 measured columns and a class id."""
    return flows_from_events(table(spark, sf_dir, "events"))


def flows_from_events(events: DataFrame) -> DataFrame:
    ports = " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PORTS))
    measures = {
        "destination_port": f"CASE k % 10 {ports} ELSE 40000 + k END",
        "flow_duration": "value * 4000",
        "total_fwd_packets": "1 + k % 9",
        "total_backward_packets": "k % 4",
        "total_length_of_fwd_packets": "value * 10000",
        "total_length_of_bwd_packets": "value * (k % 7) * 100",
        "flow_bytes_s": "value * 1000000",
        "flow_iat_mean": "value * 100",
        "fin_flag_count": "CAST(k % 3 = 0 AS INT)",
        "syn_flag_count": "k % 2",
        "rst_flag_count": "CAST(k % 11 = 0 AS INT)",
        "psh_flag_count": "k % 5",
        "urg_flag_count": "CAST(k % 17 = 0 AS INT)",
        "init_win_bytes_forward": "k * 256",
        "init_win_bytes_backward": "k * 128",
        "active_mean": "value",
        "idle_mean": "k",
    }
    label = "CASE WHEN event_type = 'error' AND k < 20 THEN CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 10 END ELSE 0 END"
    keyed = events.selectExpr(
        "event_id", "user_id", "ts", "event_type", "value", "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k"
    )
    return keyed.selectExpr(
        "event_id AS flow_id", "user_id AS host", "ts",
        *[f"CAST({e} AS DOUBLE) AS {name}" for name, e in measures.items()], f"{label} AS label_id",
    )


def enriched(spark, sf_dir) -> DataFrame:
    return add_protocol_columns(flows(spark, sf_dir))


def predictions(spark, sf_dir) -> DataFrame:
    """Every flow as a scored item: y_true, y_pred, 15 probabilities."""
    called = flows(spark, sf_dir).selectExpr(
        "flow_id AS session_id", "label_id AS y_true",
        "CASE WHEN flow_id % 7 = 0 THEN 0 WHEN flow_id % 11 = 0 THEN 4 ELSE label_id END AS y_pred",
    )
    # Tenths as whole numbers, so that both engines divide the same integers.
    tenths = [
        f"10 + CASE WHEN y_pred = {c} THEN 20 + session_id % 13 * 40 ELSE 0 END + (session_id * 31 + {c * 17}) % 5"
        for c in range(N_CLASSES)
    ]
    scored = called.selectExpr("*", *[f"{e} AS t{c}" for c, e in enumerate(tenths)])
    totalled = scored.selectExpr("*", f"CAST({' + '.join(f't{c}' for c in range(N_CLASSES))} AS DOUBLE) AS total")
    shares = ", ".join(f"round(t{c} / total, 9)" for c in range(N_CLASSES))
    return totalled.selectExpr("session_id", "y_true", "y_pred", f"array({shares}) AS probs")


# The same three tables as DuckDB common table expressions.
FLOWS_CTE = f"""
keyed AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events
),
flows AS (
  SELECT event_id AS flow_id, user_id AS host, ts,
    CAST(CASE k % 10 {' '.join(f'WHEN {i} THEN {p}' for i, p in enumerate(PORTS))}
         ELSE k + 40000 END AS DOUBLE) AS destination_port,
    value * 4000 AS flow_duration,
    CAST(k % 9 + 1 AS DOUBLE) AS total_fwd_packets,
    CAST(k % 4 AS DOUBLE) AS total_backward_packets,
    value * 10000 AS total_length_of_fwd_packets,
    value * (k % 7) * 100 AS total_length_of_bwd_packets,
    value * 1000000 AS flow_bytes_s,
    value * 100 AS flow_iat_mean,
    CAST(k % 3 = 0 AS INT) + 0e0 AS fin_flag_count,
    k % 2 + 0e0 AS syn_flag_count,
    CAST(k % 11 = 0 AS INT) + 0e0 AS rst_flag_count,
    k % 5 + 0e0 AS psh_flag_count,
    CAST(k % 17 = 0 AS INT) + 0e0 AS urg_flag_count,
    k * 256 + 0e0 AS init_win_bytes_forward,
    k * 128 + 0e0 AS init_win_bytes_backward,
    value AS active_mean,
    k + 0e0 AS idle_mean,
    CAST(CASE WHEN event_type = 'error' AND k < 20
         THEN CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 10 END ELSE 0 END AS INT) AS label_id
  FROM keyed
)"""

ENRICHED_CTE = FLOWS_CTE + """,
enriched AS (
  SELECT *,
    CASE WHEN destination_port IN (53) THEN 1
         WHEN destination_port IN (80, 8080, 8000, 3000) THEN 2
         WHEN destination_port IN (443, 8443, 4443) THEN 3
         WHEN destination_port IN (21, 22, 25, 143, 993, 995, 3306, 5432)
              OR total_length_of_fwd_packets > 1000000 THEN 4
         ELSE 0 END AS log_type,
    CASE WHEN fin_flag_count + syn_flag_count > 0 THEN 1 ELSE 0 END AS zeek_proto,
    CASE WHEN rst_flag_count > 0 THEN 2
         WHEN syn_flag_count > 0 AND total_backward_packets = 0 THEN 1
         WHEN syn_flag_count > 0 AND fin_flag_count > 0 THEN 0
         ELSE 3 END AS zeek_conn_state,
    CASE CAST(destination_port AS INT) WHEN 53 THEN 1 WHEN 80 THEN 2 WHEN 443 THEN 3 WHEN 21 THEN 4
         WHEN 22 THEN 5 WHEN 25 THEN 6 WHEN 143 THEN 7 ELSE 0 END AS zeek_service
  FROM flows
)"""

PREDICTIONS_CTE = FLOWS_CTE + """,
called AS (
  SELECT flow_id AS session_id, label_id AS y_true,
    CAST(CASE WHEN flow_id % 7 = 0 THEN 0 WHEN flow_id % 11 = 0 THEN 4 ELSE label_id END AS INT) AS y_pred
  FROM flows
),
tenths AS (
  SELECT *, list_transform(range(15), lambda c: 10
    + CASE WHEN c = y_pred THEN 20 + session_id % 13 * 40 ELSE 0 END
    + (session_id * 31 + c * 17) % 5) AS t
  FROM called
),
preds AS (
  SELECT session_id, y_true, y_pred,
    list_transform(t, lambda x: round(x / CAST(list_sum(t) AS DOUBLE), 9)) AS probs
  FROM tenths
)"""


def sessions_cte(size=20, stride=20, source="enriched", name="session_flows"):
    """Long-form count windows per host; append after ENRICHED_CTE."""
    return f""",
indexed_{name} AS (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, flow_id) - 1 AS i,
         count(*) OVER (PARTITION BY host) AS host_total
  FROM {source}
),
{name} AS (
  SELECT s.*, CAST(w.session_idx AS BIGINT) AS session_idx,
         CAST(i - w.session_idx * {stride} AS INT) AS pos
  FROM indexed_{name} s,
       LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((i - {size} + 1) / {stride}e0) AS BIGINT)),
                                    i // {stride} + 1)) AS session_idx) w
  WHERE w.session_idx * {stride} + {size} <= host_total
)"""


def values_cte(name, columns, rows):
    """A fixed dimension as a VALUES expression; strings are quoted, lists become '|' text."""

    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"
