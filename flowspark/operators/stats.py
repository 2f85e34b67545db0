"""The 26 statistics of a session in one aggregate."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.cleaning import clean_sql
from flowspark.schema import LOG_TYPE_NAMES, SHORT_FLOW_US, STAT_NAMES

_EPS = "1e-9D"
_BPS_CAP = "1e8D"
_IAT_CAP = "1e9D"


def session_stats(session_flows: DataFrame, keys=("host", "session_idx"), extra_aggs=(), bounded=True):
    """One row per key with the 26 statistics, then the extra aggregates.

    bounded=True keeps each group's ports in a list inside the one aggregate: right for count
    windows, whose size is fixed. bounded=False counts ports by a second grouping, for groups of
    any size (time windows). Input columns that are absent count as 0.
    """
    keys = list(keys)
    aggs = _aggregates(session_flows.columns, bounded)
    grouped = session_flows.groupBy(*keys).agg(*[F.expr(e).alias(name) for name, e in aggs.items()], *extra_aggs)
    if not bounded:
        grouped = grouped.join(port_diversity(session_flows, keys), keys)
    return _finished(grouped, keys, bounded)


def prefix_stats(session_flows: DataFrame, points, keys=("host", "session_idx"), name="n_flows", extra=None, whole=None):
    """The 26 statistics of the first n flows of each session, for every n of points, from one running window.

    extra maps names to further aggregates, given as SQL text, and whole to aggregates over all flows of the
    session. A session has a row for each n that it reaches.
    """
    keys = list(keys)
    listed = ", ".join(f"`{k}`" for k in keys)
    window = f"(PARTITION BY {listed} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    aggs = {**_aggregates(session_flows.columns, True), **(extra or {})}
    running = session_flows.selectExpr(*[f"`{k}`" for k in keys], f"pos + 1 AS `{name}`",
                                       *[f"{running_sql(e, window)} AS `{n}`" for n, e in aggs.items()],
                                       *[f"{running_sql(e, f'(PARTITION BY {listed})')} AS `{n}`" for n, e in (whole or {}).items()])
    cut = running.filter(F.col(name).isin(list(points)))
    return _finished(cut, [*keys, name], True)


_CALL = re.compile(r"\b(sum|avg|max|min|count|count_if|stddev_pop|collect_list)\(")


def running_sql(sql, window):
    """Every aggregate call of an expression taken over a window."""
    out, at = [], 0
    while found := _CALL.search(sql, at):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(f"{sql[at:end]} OVER {window}")
        at = end
    return "".join(out) + sql[at:]


def stat_inputs(columns):
    """Those of the columns that the statistics are taken from."""
    read = " ".join(_aggregates(columns, True).values())
    return [c for c in columns if f"`{c}`" in read]


def _aggregates(columns, bounded):
    """The statistics, or what they are derived from, as aggregates in SQL text."""
    have = set(columns)

    def col(name):
        return f"CAST(`{name}` AS DOUBLE)" if name in have else "0D"

    fwd, bwd = col("total_length_of_fwd_packets"), col("total_length_of_bwd_packets")
    fwd_pkts, bwd_pkts = col("total_fwd_packets"), col("total_backward_packets")
    total, pkts = f"({fwd} + {bwd})", f"({fwd_pkts} + {bwd_pkts})"
    duration = col("flow_duration")
    bps = f"least(greatest({col('flow_bytes_s')}, 0D), {_BPS_CAP})"
    iat = f"least(greatest({col('flow_iat_mean')}, 0D), {_IAT_CAP})"
    fin, syn, rst, psh, urg = (col(f"{f}_flag_count") for f in ("fin", "syn", "rst", "psh", "urg"))
    flags = f"sum({fin} + {syn} + {rst} + {psh} + {urg} + {_EPS})"
    idle, active = f"sum({col('idle_mean')})", f"sum({col('active_mean')})"
    log_counts = ", ".join(f"count_if(CAST({col('log_type')} AS INT) = {code})" for code in LOG_TYPE_NAMES)

    aggs = {
        "stat_flow_count": "CAST(count(*) AS DOUBLE)",
        "stat_total_fwd_bytes": f"sum({fwd})",
        "stat_total_bwd_bytes": f"sum({bwd})",
        "stat_avg_bytes_per_flow": f"avg({total})",
        "stat_std_bytes_per_flow": f"stddev_pop({total}) + {_EPS}",
        "stat_avg_duration": f"avg({duration})",
        "stat_std_duration": f"stddev_pop({duration}) + {_EPS}",
        "stat_avg_pkts_per_flow": f"avg({pkts})",
        "stat_std_pkts_per_flow": f"stddev_pop({pkts}) + {_EPS}",
        "stat_bytes_ratio": f"sum({fwd}) / (sum({total}) + {_EPS})",
        "stat_pkt_ratio": f"sum({fwd_pkts}) / (sum({pkts}) + {_EPS})",
        "stat_syn_ratio": f"sum({syn}) / {flags}",
        "stat_fin_ratio": f"sum({fin}) / {flags}",
        "stat_rst_ratio": f"sum({rst}) / {flags}",
        "stat_psh_ratio": f"sum({psh}) / {flags}",
        "stat_urg_ratio": f"sum({urg}) / {flags}",
        "stat_avg_flow_bps": f"avg({bps})",
        "stat_max_flow_bps": f"max({bps})",
        "stat_avg_flow_iat": f"avg({iat})",
        "stat_std_flow_iat": f"stddev_pop({iat}) + {_EPS}",
        "stat_short_flow_ratio": f"avg(CASE WHEN {duration} < {SHORT_FLOW_US} THEN 1D ELSE 0D END)",
        "stat_avg_win_size": f"avg(({col('init_win_bytes_forward')} + {col('init_win_bytes_backward')}) / 2D)",
        "stat_idle_active_ratio": f"{idle} / ({active} + {_EPS} + {idle})",
        "_log_counts": f"array({log_counts})",
    }
    if bounded:
        aggs["_ports"] = f"collect_list(CAST({col('destination_port')} AS BIGINT))"
    return aggs


def _finished(grouped, keys, bounded):
    """The columns in order, derived and cleaned."""
    derived = {"stat_log_type_entropy": entropy_sql("_log_counts")}
    if bounded:
        repeats = "transform(array_distinct(_ports), p -> size(filter(_ports, q -> q = p)))"
        derived["stat_port_entropy"] = entropy_sql(repeats)
        derived["stat_unique_dst_ports"] = "CAST(size(array_distinct(_ports)) AS DOUBLE)"
    dropped = {"_log_counts", "_ports"}
    wide = grouped.selectExpr(
        *[f"`{c}`" for c in grouped.columns if c not in dropped], *[f"{e} AS {n}" for n, e in derived.items()]
    )
    others = [f"`{c}`" for c in wide.columns if c not in keys and c not in STAT_NAMES]
    finished = [f"{clean_sql(c, 'bound', limit=None)} AS {c}" for c in STAT_NAMES]
    return wide.selectExpr(*[f"`{k}`" for k in keys], *finished, *others)


def entropy_sql(counts) -> str:
    """Base-2 entropy of an array of counts, given as SQL text."""
    n = f"aggregate({counts}, 0D, (s, c) -> s + c)"
    spread = f"aggregate({counts}, 0D, (s, c) -> s + CASE WHEN c > 0 THEN c * log2(c) ELSE 0D END)"
    return f"CASE WHEN {n} > 0 THEN greatest(log2({n}) - {spread} / {n}, 0D) ELSE 0D END"


def port_diversity(flows: DataFrame, keys):
    """Port entropy and distinct ports by two groupings, so that no group is held in one place."""
    port = F.expr("CAST(CAST(destination_port AS DOUBLE) AS BIGINT)").alias("_port")
    per_port = flows.groupBy(*keys, port).agg(F.expr("CAST(count(*) AS DOUBLE)").alias("_n"))
    return per_port.groupBy(*keys).agg(
        F.expr("greatest(log2(sum(_n)) - sum(_n * log2(_n)) / sum(_n), 0D)").alias("stat_port_entropy"),
        F.expr("CAST(count(*) AS DOUBLE)").alias("stat_unique_dst_ports"),
    )
