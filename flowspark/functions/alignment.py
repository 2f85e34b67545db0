"""From the 78 raw columns to the 81 columns a model is trained on, with checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.errors import FeatureDimensionError, NaNInfError, SessionSizeError
from flowspark.functions.cleaning import bad_sql
from flowspark.functions.protocol import add_protocol_columns, conn_state_sql, proto_flag_sql, service_code_sql
from flowspark.schema import (
    DROPPED_FEATURE_INDEX, FEATURES, N_RAW_FEATURES, N_TRAINED_FEATURES, PROTOCOL_COLUMNS, SESSION_SIZE,
    TRAINED_FEATURES,
)


def trained_feature_names():
    return list(TRAINED_FEATURES)


def check_width(df: DataFrame, expected=FEATURES, stage="input"):
    """Raise when the table lacks any expected column; needs no job."""
    found = sum(c in set(df.columns) for c in expected)
    if found != len(expected):
        raise FeatureDimensionError(stage, len(expected), found)
    return df


def check_finite(df: DataFrame, columns, stage="input"):
    """Count bad cells in one pass and raise when there are any."""
    n_bad = df.agg(F.sum(bad_cells(columns)).alias("n")).first()["n"] or 0
    if n_bad:
        raise NaNInfError(stage, int(n_bad))
    return df


def bad_cells(columns) -> Column:
    """Number of NaN, infinite or null cells in a row."""
    return F.expr(" + ".join(f"CAST({bad_sql(f'CAST(`{c}` AS DOUBLE)')} AS INT)" for c in columns))


def check_session_sizes(session_sizes: DataFrame, size=SESSION_SIZE, column="n_flows"):
    """Raise when any session has another number of flows; names one offending size."""
    wrong = session_sizes.filter(F.col(column) != size).agg(F.min(column).alias("n")).first()["n"]
    if wrong is not None:
        raise SessionSizeError(size, int(wrong))
    return session_sizes


def realign(df: DataFrame, log_type_column="log_type", extra=()):
    """Select the 81 trained columns in order from a 78-column table."""
    check_width(df, FEATURES, "realign-input")
    given = log_type_column if log_type_column in df.columns else None
    wide = add_protocol_columns(df, given)
    return wide.selectExpr(
        *[f"`{c}`" for c in extra if c in df.columns], *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in TRAINED_FEATURES]
    )


def realign_array(features, log_type) -> Column:
    """Array form of realign for request rows (column names or SQL text); a wrong width fails the query."""

    def at(name):
        return f"element_at({features}, {FEATURES.index(name) + 1})"

    tail = ", ".join(f"CAST({e} AS DOUBLE)" for e in protocol_sql(at, log_type).values())
    first_after = DROPPED_FEATURE_INDEX + 2
    return F.expr(width_checked_sql(features, f"""concat(
        slice({features}, 1, {DROPPED_FEATURE_INDEX}),
        slice({features}, {first_after}, {N_RAW_FEATURES - first_after + 1}), array({tail}))"""))


def protocol_sql(at, log_type):
    """The protocol columns as SQL text by name; at gives the text of a raw column."""
    fin, syn = at("fin_flag_count"), at("syn_flag_count")
    state = conn_state_sql(syn, fin, at("rst_flag_count"), at("total_backward_packets"))
    made = (log_type, proto_flag_sql(fin, syn), state, service_code_sql(at("destination_port")))
    return dict(zip(PROTOCOL_COLUMNS, made))


def width_checked_sql(features, value) -> str:
    """The value where the array of a request row has the raw width; a wrong width fails the query."""
    return f"""CASE WHEN size({features}) = {N_RAW_FEATURES} THEN {value}
      ELSE raise_error(concat('realign-input: {N_RAW_FEATURES} feature columns expected, ', size({features}), ' found'))
      END"""


assert N_TRAINED_FEATURES == N_RAW_FEATURES - 1 + 4
