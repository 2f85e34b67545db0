"""Protocol-view columns derived from ports, bytes and flag counts.

Arguments are column names or SQL text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.literals import literal_map, sql_text
from flowspark.schema import (
    CONN_STATE_CODES, DNS_PORTS, FILES_BYTE_THRESHOLD, FILES_PORTS, HTTP_PORTS, LOG_TYPE_NAMES,
    SERVICE_CODES, SSL_PORTS,
)


def _number(value):
    """Null and NaN count as 0."""
    return f"coalesce(nanvl(CAST({value} AS DOUBLE), 0D), 0D)"


def _port(value):
    """Ports arrive as doubles; fractions are cut off."""
    return f"CAST({_number(value)} AS BIGINT)"


def _ports(numbers):
    return ", ".join(str(n) for n in numbers)


def log_type_sql(port, fwd_bytes):
    """0 conn, 1 dns, 2 http, 3 ssl, 4 files; dns wins over http over ssl over files."""
    p = _port(port)
    return (
        f"CASE WHEN {p} IN ({_ports(DNS_PORTS)}) THEN 1 WHEN {p} IN ({_ports(HTTP_PORTS)}) THEN 2 "
        f"WHEN {p} IN ({_ports(SSL_PORTS)}) THEN 3 "
        f"WHEN {p} IN ({_ports(FILES_PORTS)}) OR {_number(fwd_bytes)} > {FILES_BYTE_THRESHOLD} THEN 4 ELSE 0 END"
    )


def proto_flag_sql(fin, syn):
    """1 for TCP (any FIN or SYN), 0 otherwise."""
    return f"CASE WHEN {_number(fin)} + {_number(syn)} > 0 THEN 1 ELSE 0 END"


def conn_state_sql(syn, fin, rst, bwd_pkts):
    """State code used as a model column. A SYN without a reply is S0 even when FIN is set."""
    syn, fin, rst, bwd = (_number(v) for v in (syn, fin, rst, bwd_pkts))
    code = CONN_STATE_CODES
    return (
        f"CASE WHEN {rst} > 0 THEN {code['RSTO']} WHEN {syn} > 0 AND {bwd} = 0 AND {rst} = 0 THEN {code['S0']} "
        f"WHEN {syn} > 0 AND {fin} > 0 AND {rst} = 0 THEN {code['SF']} ELSE {code['OTH']} END"
    )


def conn_state_token_sql(syn, fin, rst, fwd_pkts, bwd_pkts):
    """State as text; unlike conn_state, SF goes before S0 and two-way traffic is SF."""
    syn, fin, rst, fwd, bwd = (_number(v) for v in (syn, fin, rst, fwd_pkts, bwd_pkts))
    return (
        f"CASE WHEN {rst} > 0 THEN 'RSTO' WHEN {syn} > 0 AND {fin} > 0 THEN 'SF' "
        f"WHEN {syn} > 0 AND {bwd} = 0 THEN 'S0' WHEN {fwd} > 0 AND {bwd} > 0 THEN 'SF' ELSE 'OTH' END"
    )


def service_code_sql(port):
    whens = " ".join(f"WHEN {p} THEN {c}" for p, c in SERVICE_CODES.items())
    return f"CASE {_port(port)} {whens} ELSE 0 END"


def log_type(port, fwd_bytes) -> Column:
    return F.expr(log_type_sql(port, fwd_bytes))


def log_type_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(LOG_TYPE_NAMES), code.cast("int")), code.cast("string"))


def proto_flag(fin, syn) -> Column:
    return F.expr(proto_flag_sql(fin, syn))


def proto_name(fin, syn) -> Column:
    return F.expr(f"CASE WHEN {proto_flag_sql(fin, syn)} = 1 THEN 'tcp' ELSE 'udp' END")


def conn_state(syn, fin, rst, bwd_pkts) -> Column:
    return F.expr(conn_state_sql(syn, fin, rst, bwd_pkts))


def conn_state_token(syn, fin, rst, fwd_pkts, bwd_pkts) -> Column:
    return F.expr(conn_state_token_sql(syn, fin, rst, fwd_pkts, bwd_pkts))


def service_code(port) -> Column:
    return F.expr(service_code_sql(port))


def add_protocol_columns(df: DataFrame, log_type_column=None):
    """Append the four protocol columns; a missing input column counts as 0.

    log_type_column names a caller-supplied log type to keep instead of deriving one.
    """
    have = set(df.columns)

    def col(name):
        return f"`{name}`" if name in have else sql_text(0.0)

    port, fin, syn = col("destination_port"), col("fin_flag_count"), col("syn_flag_count")
    given = f"CAST(`{log_type_column}` AS INT)" if log_type_column else None
    columns = {
        "log_type": given or log_type_sql(port, col("total_length_of_fwd_packets")),
        "zeek_proto": proto_flag_sql(fin, syn),
        "zeek_conn_state": conn_state_sql(syn, fin, col("rst_flag_count"), col("total_backward_packets")),
        "zeek_service": service_code_sql(port),
    }
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *[f"{e} AS {name}" for name, e in columns.items()])
