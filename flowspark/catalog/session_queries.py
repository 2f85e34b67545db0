"""Queries over count windows and time windows."""

from pyspark.sql import functions as F

from flowspark.catalog.adapters import ENRICHED_CTE, FLOW_COLUMNS, enriched, flows, sessions_cte
from flowspark.operators.quality import log_type_map, split_by_size
from flowspark.operators.sampling import mask_fields, next_event_pairs, pad_sessions
from flowspark.operators.sessions import (
    benign_sessions, five_minute_windows, flow_rows_with_session_label, session_arrays, session_summary,
    session_truth, sessionize, truncate_sessions,
)
from flowspark.operators.stats import session_stats
from flowspark.plans.prepare import session_prefixes
from flowspark.schema import MAX_SEQ_LEN, STAT_NAMES, TRUNCATION_POINTS

KEYS = ["host", "session_idx"]

# Decimals kept per statistic: few where the values are large.
STAT_DIGITS = {
    "stat_total_fwd_bytes": 1, "stat_total_bwd_bytes": 1, "stat_avg_bytes_per_flow": 2,
    "stat_std_bytes_per_flow": 2, "stat_avg_duration": 2, "stat_std_duration": 2,
    "stat_avg_flow_bps": 1, "stat_max_flow_bps": 1, "stat_avg_flow_iat": 3, "stat_std_flow_iat": 3,
}


def rounded_stats():
    return [F.round(F.col(c), STAT_DIGITS.get(c, 6)).alias(c) for c in STAT_NAMES]


def stats_sql(source="session_flows", keys="host, session_idx", tail=""):
    """SELECT of the 26 statistics by textbook formulas."""
    f = "total_length_of_fwd_packets"
    b = "total_length_of_bwd_packets"
    p = "(total_fwd_packets + total_backward_packets)"
    flags = ("sum(fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + urg_flag_count + 1e-9)")
    bps = "least(greatest(flow_bytes_s, 0e0), 1e8)"
    iat = "least(greatest(flow_iat_mean, 0e0), 1e9)"
    exprs = {
        "stat_flow_count": "CAST(count(*) AS DOUBLE)",
        "stat_total_fwd_bytes": f"sum({f})",
        "stat_total_bwd_bytes": f"sum({b})",
        "stat_avg_bytes_per_flow": f"avg({f} + {b})",
        "stat_std_bytes_per_flow": f"stddev_pop({f} + {b}) + 1e-9",
        "stat_avg_duration": "avg(flow_duration)",
        "stat_std_duration": "stddev_pop(flow_duration) + 1e-9",
        "stat_avg_pkts_per_flow": f"avg({p})",
        "stat_std_pkts_per_flow": f"stddev_pop({p}) + 1e-9",
        "stat_bytes_ratio": f"sum({f}) / (sum({f} + {b}) + 1e-9)",
        "stat_pkt_ratio": f"sum(total_fwd_packets) / (sum({p}) + 1e-9)",
        "stat_port_entropy": "entropy(CAST(destination_port AS BIGINT))",
        "stat_log_type_entropy": "entropy(log_type)",
        "stat_syn_ratio": f"sum(syn_flag_count) / {flags}",
        "stat_fin_ratio": f"sum(fin_flag_count) / {flags}",
        "stat_rst_ratio": f"sum(rst_flag_count) / {flags}",
        "stat_psh_ratio": f"sum(psh_flag_count) / {flags}",
        "stat_urg_ratio": f"sum(urg_flag_count) / {flags}",
        "stat_avg_flow_bps": f"avg({bps})",
        "stat_max_flow_bps": f"max({bps})",
        "stat_avg_flow_iat": f"avg({iat})",
        "stat_std_flow_iat": f"stddev_pop({iat}) + 1e-9",
        "stat_unique_dst_ports": "CAST(count(DISTINCT destination_port) AS DOUBLE)",
        "stat_short_flow_ratio": "avg(CASE WHEN flow_duration < 100000 THEN 1e0 ELSE 0e0 END)",
        "stat_avg_win_size": "avg((init_win_bytes_forward + init_win_bytes_backward) / 2e0)",
        "stat_idle_active_ratio": "sum(idle_mean) / (sum(active_mean) + 1e-9 + sum(idle_mean))",
    }
    columns = ",\n  ".join(f"round({e}, {STAT_DIGITS.get(n, 6)}) AS {n}" for n, e in exprs.items())
    return f"SELECT {keys},\n  {columns}{tail}\nFROM {source} GROUP BY {keys}"


# Session label: with any attack the most frequent attack, ties to the lowest id.
LABELLED_CTE = """,
label_counts AS (SELECT host, session_idx, label_id, count(*) AS n FROM session_flows GROUP BY ALL),
labelled AS (
  SELECT host, session_idx,
    CAST(coalesce(arg_max(CASE WHEN label_id <> 0 THEN label_id END,
                          CASE WHEN label_id <> 0 THEN n * 100 - label_id END), 0) AS INT) AS label,
    bool_or(label_id <> 0) AS has_attack,
    coalesce(string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) FILTER (label_id <> 0), '') AS attack_ids,
    CAST(sum(n) AS INT) AS n_flows
  FROM label_counts GROUP BY ALL
)"""


def windows(spark, sf_dir, **options):
    return sessionize(enriched(spark, sf_dir), **options)


def _summary(session_flows, keys=KEYS):
    return session_summary(session_flows, keys).withColumn(
        "attack_ids", F.array_join(F.transform("attack_ids", lambda c: c.cast("string")), ",")
    )


def sessions_tumbling(spark, sf_dir):
    return _summary(windows(spark, sf_dir))


def sessions_overlap(spark, sf_dir):
    return _summary(windows(spark, sf_dir, stride=10))


def sessions_benign(spark, sf_dir):
    found = benign_sessions(enriched(spark, sf_dir))
    return found.groupBy(*KEYS).agg(
        F.count("*").alias("n_flows"), F.min("flow_id").alias("first_flow"), F.max("flow_id").alias("last_flow")
    )


def sessions_global(spark, sf_dir):
    """One sequence over the whole table, as when flows carry no host."""
    found = windows(spark, sf_dir, keys=())
    return found.groupBy("session_idx").agg(
        F.count("*").alias("n_flows"), F.min("flow_id").alias("first_flow"), F.max("flow_id").alias("last_flow"),
        F.count_if(F.col("label_id") != 0).alias("n_attacks"),
    )


def session_positions(spark, sf_dir):
    return windows(spark, sf_dir, stride=15).select("flow_id", "host", "session_idx", "pos")


def stats(spark, sf_dir):
    return session_stats(windows(spark, sf_dir), KEYS).select(*KEYS, *rounded_stats())


def time_window_stats(spark, sf_dir):
    """The statistics over groups of any size: host and day."""
    rows = enriched(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return session_stats(rows, ["host", "day"], bounded=False).select("host", "day", *rounded_stats())


def truncated(spark, sf_dir):
    cut = truncate_sessions(windows(spark, sf_dir))
    return cut.groupBy(*KEYS, "n").agg(
        F.count("*").alias("n_flows"), F.round(F.sum("total_length_of_fwd_packets"), 1).alias("fwd_bytes"),
        F.max("pos").alias("last_pos"),
    )


def prefixes(spark, sf_dir):
    """Statistics and labels of the first flows of every session, at all cut points from one pass."""
    found = session_prefixes(windows(spark, sf_dir), TRUNCATION_POINTS, KEYS)
    return found.select(*KEYS, "n_flows", "observed_label", "label", *rounded_stats())


def truth(spark, sf_dir):
    found = session_truth(windows(spark, sf_dir))
    pairs = F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.withColumn("distribution", F.array_join(F.array_sort(pairs), ","))


def five_minutes(spark, sf_dir):
    found = five_minute_windows(flows(spark, sf_dir))
    return found.select(
        "host", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_flows", "label",
        "has_attack", F.round("total_bytes", 1).alias("total_bytes"),
    )


def session_sizes(spark, sf_dir):
    """Sizes of five-minute groups, split by whether they hold 2 flows; both parts."""
    rows = flows(spark, sf_dir).withColumn("bucket", F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH"))
    right, wrong = split_by_size(rows, ["host", "bucket"], 2)
    return right.withColumn("ok", F.lit(True)).unionByName(wrong.withColumn("ok", F.lit(False)))


def session_log_types(spark, sf_dir):
    found = log_type_map(windows(spark, sf_dir), KEYS)
    pairs = F.transform(F.map_entries("log_type_distribution"),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select(*KEYS, F.array_join(F.array_sort(pairs), ",").alias("log_types"))


def flow_labels(spark, sf_dir):
    return flow_rows_with_session_label(windows(spark, sf_dir)).select("flow_id", *KEYS, "label_id", "session_label")


_ARRAY_FEATURES = ["destination_port", "total_fwd_packets", "idle_mean"]


def _vector_text(v):
    return F.array_join(F.transform(v, lambda x: x.cast("bigint").cast("string")), " ")


def padded(spark, sf_dir):
    nested = session_arrays(windows(spark, sf_dir), _ARRAY_FEATURES)
    fixed = pad_sessions(nested, MAX_SEQ_LEN, len(_ARRAY_FEATURES))
    return fixed.select(
        *KEYS, "label", F.col("length").cast("bigint").alias("length"),
        F.size("features").cast("bigint").alias("rows_total"),
        F.size(F.filter("padding_mask", lambda m: m)).cast("bigint").alias("rows_padded"),
        F.array_join(F.transform("features", _vector_text), ",").alias("features"),
        F.array_join(F.transform("log_types", lambda x: x.cast("string")), "").alias("log_types"),
    )


_PAD_SQL = f"""
WITH {ENRICHED_CTE}{sessions_cte()}{LABELLED_CTE},
joined AS (
  SELECT host, session_idx,
    string_agg(CAST(destination_port AS BIGINT) || ' ' || CAST(total_fwd_packets AS BIGINT) || ' '
               || CAST(idle_mean AS BIGINT), ',' ORDER BY pos) AS f,
    string_agg(CAST(log_type AS VARCHAR), '' ORDER BY pos) AS t
  FROM session_flows GROUP BY ALL
)
SELECT host, session_idx, label, CAST(20 AS BIGINT) AS length, CAST(60 AS BIGINT) AS rows_total,
  CAST(40 AS BIGINT) AS rows_padded, f || repeat(',0 0 0', 40) AS features, t || repeat('0', 40) AS log_types
FROM joined JOIN labelled USING (host, session_idx)"""


def masked(spark, sf_dir):
    return mask_fields(windows(spark, sf_dir), FLOW_COLUMNS).select(
        *KEYS, "pos", F.col("field"), "masked", F.round("value", 2).alias("value"), F.round("target", 2).alias("target")
    )


_MASK_SQL = f"""
WITH {ENRICHED_CTE}{sessions_cte()},
melted AS (
  UNPIVOT (SELECT host, session_idx, pos, {', '.join(FLOW_COLUMNS)} FROM session_flows)
  ON {', '.join(FLOW_COLUMNS)} INTO NAME field VALUE original
),
drawn AS (
  SELECT *, CAST('0x' || substr(md5('42|' || host || '|' || session_idx || '|' || pos || '|' || field), 1, 8) AS BIGINT)
            < {int(0.15 * 2 ** 32)} AS masked
  FROM melted
)
SELECT host, session_idx, pos, field, masked, CASE WHEN masked THEN 0e0 ELSE round(original, 2) END AS value,
  CASE WHEN masked THEN round(original, 2) END AS target
FROM drawn"""


def next_events(spark, sf_dir):
    pairs = next_event_pairs(windows(spark, sf_dir), _ARRAY_FEATURES)
    return pairs.select(
        *KEYS, F.col("context_length").cast("bigint").alias("context_length"),
        F.array_join(F.transform("context", _vector_text), ",").alias("context"),
        _vector_text(F.col("target")).alias("target"),
    )


_NEXT_SQL = f"""
WITH {ENRICHED_CTE}{sessions_cte()},
texts AS (SELECT *, CAST(destination_port AS BIGINT) || ' ' || CAST(total_fwd_packets AS BIGINT) || ' '
                    || CAST(idle_mean AS BIGINT) AS v FROM session_flows)
SELECT host, session_idx, count(*) - 1 AS context_length,
  string_agg(v, ',' ORDER BY pos) FILTER (pos < 19) AS context, max(v) FILTER (pos = 19) AS target
FROM texts GROUP BY ALL"""


_TUMBLING = f"WITH {ENRICHED_CTE}{sessions_cte()}"
_SUMMARY_SQL = "SELECT host, session_idx, label, has_attack, attack_ids, n_flows FROM labelled"

QUERIES = {
    "sessions_tumbling": (sessions_tumbling, f"{_TUMBLING}{LABELLED_CTE}\n{_SUMMARY_SQL}"),
    "sessions_overlap": (sessions_overlap, f"WITH {ENRICHED_CTE}{sessions_cte(20, 10)}{LABELLED_CTE}\n{_SUMMARY_SQL}"),
    "sessions_benign": (sessions_benign, f"""
WITH {ENRICHED_CTE}, benign AS (SELECT * FROM enriched WHERE label_id = 0){sessions_cte(source='benign')}
SELECT host, session_idx, count(*) AS n_flows, min(flow_id) AS first_flow, max(flow_id) AS last_flow
FROM session_flows GROUP BY ALL"""),
    "sessions_global": (sessions_global, f"""
WITH {ENRICHED_CTE},
indexed AS (SELECT *, row_number() OVER (ORDER BY ts, flow_id) - 1 AS i, count(*) OVER () AS total FROM enriched)
SELECT CAST(i // 20 AS BIGINT) AS session_idx, count(*) AS n_flows, min(flow_id) AS first_flow, max(flow_id) AS last_flow,
  count(*) FILTER (label_id <> 0) AS n_attacks
FROM indexed WHERE (i // 20) * 20 + 20 <= total GROUP BY 1"""),
    "session_positions": (session_positions, f"""
WITH {ENRICHED_CTE}{sessions_cte(20, 15)} SELECT flow_id, host, session_idx, pos FROM session_flows"""),
    "session_stats": (stats, f"{_TUMBLING}\n{stats_sql()}"),
    "daily_stats": (time_window_stats, f"""
WITH {ENRICHED_CTE}, daily AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM enriched)
{stats_sql('daily', 'host, day')}"""),
    "session_truncate": (truncated, f"""
{_TUMBLING}
SELECT host, session_idx, CAST(n AS INT) AS n, count(*) AS n_flows,
  round(sum(total_length_of_fwd_packets), 1) AS fwd_bytes, max(pos) AS last_pos
FROM session_flows, (VALUES {", ".join(f"({n})" for n in TRUNCATION_POINTS)}) v(n) WHERE pos < n GROUP BY host, session_idx, n"""),
    "session_prefixes": (prefixes, f"""
{_TUMBLING}{LABELLED_CTE},
pre AS (SELECT session_flows.*, n AS n_flows FROM session_flows, (VALUES {", ".join(f"(CAST({n} AS INT))" for n in TRUNCATION_POINTS)}) v(n) WHERE pos < n),
s AS ({stats_sql('pre', 'host, session_idx, n_flows')}),
k AS (SELECT host, session_idx, n_flows, label_id, count(*) AS n FROM pre GROUP BY ALL),
o AS (SELECT host, session_idx, n_flows, CAST(coalesce(arg_max(CASE WHEN label_id <> 0 THEN label_id END,
  CASE WHEN label_id <> 0 THEN n * 100 - label_id END), 0) AS INT) AS observed_label FROM k GROUP BY ALL)
SELECT s.*, observed_label, label FROM s JOIN o USING (host, session_idx, n_flows)
  JOIN (SELECT host, session_idx, label FROM labelled) USING (host, session_idx)"""),
    "session_truth": (truth, f"""
{_TUMBLING},
c AS (SELECT host, session_idx, label_id, count(*) AS n, min(pos) AS first_pos FROM session_flows GROUP BY ALL),
named AS (SELECT *, CASE label_id WHEN 0 THEN 'BENIGN' WHEN 2 THEN 'DDoS' WHEN 4 THEN 'DoS Hulk'
                    ELSE 'PortScan' END AS name FROM c)
SELECT host, session_idx, CAST(arg_max(label_id, n * 1000 - first_pos) AS INT) AS majority_id,
  bool_or(label_id <> 0) AS has_attack, string_agg(name || '=' || n, ',' ORDER BY name) AS distribution,
  CAST(sum(n) AS INT) AS n_flows, arg_max(name, n * 1000 - first_pos) AS majority_name
FROM named GROUP BY host, session_idx"""),
    "five_minute_windows": (five_minutes, f"""
WITH {ENRICHED_CTE},
b AS (SELECT *, strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start FROM enriched),
c AS (SELECT host, window_start, label_id, count(*) AS n, sum(total_length_of_fwd_packets + total_length_of_bwd_packets) AS t
      FROM b GROUP BY ALL)
SELECT host, window_start, CAST(sum(n) AS BIGINT) AS n_flows,
  CAST(coalesce(arg_max(CASE WHEN label_id <> 0 THEN label_id END,
                        CASE WHEN label_id <> 0 THEN n * 100 - label_id END), 0) AS INT) AS label,
  bool_or(label_id <> 0) AS has_attack, round(sum(t), 1) AS total_bytes
FROM c GROUP BY host, window_start"""),
    "session_size_check": (session_sizes, f"""
WITH {ENRICHED_CTE}
SELECT host, strftime(ts, '%Y-%m-%d %H') AS bucket, CAST(count(*) AS INT) AS n_flows, count(*) = 2 AS ok
FROM enriched GROUP BY 1, 2"""),
    "session_log_types": (session_log_types, f"""
{_TUMBLING},
c AS (SELECT host, session_idx, ['conn','dns','http','ssl','files'][log_type + 1] AS name, count(*) AS n
      FROM session_flows GROUP BY ALL)
SELECT host, session_idx, string_agg(name || '=' || n, ',' ORDER BY name) AS log_types FROM c GROUP BY 1, 2"""),
    "flow_session_labels": (flow_labels, f"""
{_TUMBLING}{LABELLED_CTE}
SELECT flow_id, host, session_idx, label_id, label AS session_label
FROM session_flows JOIN labelled USING (host, session_idx)"""),
    "pad_mask": (padded, _PAD_SQL),
    "mask_fields": (masked, _MASK_SQL),
    "next_event_pairs": (next_events, _NEXT_SQL),
}
