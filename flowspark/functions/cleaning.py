"""Numeric coercion and range cleaning of flow columns.

`value` arguments are column names or SQL text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from flowspark.functions.literals import sql_text
from flowspark.schema import CLIP_LIMIT, FEATURES


def number_sql(value) -> str:
    """Text to double; anything that is not a plain decimal number becomes null."""
    java_only = r"(?i)0x|[0-9.]\\s*[df]\\s*$"
    return f"CASE WHEN NOT rlike({value}, '{java_only}') THEN try_cast({value} AS DOUBLE) END"


def clean_sql(value, inf_policy="zero", bound=1e6, limit=CLIP_LIMIT) -> str:
    """Null and NaN to 0, then infinities to 0 ("zero") or to +-bound ("bound"), then clip to +-limit.

    NaN sorts above every number in Spark, so it has to go before the clip.
    """
    if inf_policy not in ("zero", "bound"):
        raise ValueError(f"inf_policy must be 'zero' or 'bound', not {inf_policy!r}")
    high, low = (bound, -bound) if inf_policy == "bound" else (0.0, 0.0)
    finite = (
        f"CASE WHEN {value} IS NULL OR isnan({value}) THEN 0D WHEN {value} = double('inf') THEN {sql_text(high)} "
        f"WHEN {value} = double('-inf') THEN {sql_text(low)} ELSE {value} END"
    )
    return finite if limit is None else f"least(greatest({finite}, {sql_text(-limit)}), {sql_text(limit)})"


def bad_sql(value) -> str:
    """True for null, NaN and infinite cells."""
    return f"({value} IS NULL OR isnan({value}) OR abs({value}) = double('inf'))"


def to_number(value) -> Column:
    return F.expr(number_sql(value))


def clean_number(value, inf_policy="zero", bound=1e6, limit=CLIP_LIMIT) -> Column:
    return F.expr(clean_sql(value, inf_policy, bound, limit))


def present_features(df: DataFrame, expected=FEATURES):
    """Expected columns the table has, in canonical order."""
    have = set(df.columns)
    return [c for c in expected if c in have]


def prune(df: DataFrame, expected=FEATURES, extra=()):
    """Keep only expected feature columns and the named others."""
    keep = [c for c in extra if c in df.columns]
    return df.select(*keep, *present_features(df, expected))


def pad_features(df: DataFrame, expected=FEATURES, extra=()):
    """All expected columns in canonical order as doubles, absent ones as 0."""
    have = set(df.columns)
    cols = [f"CAST(`{c}` AS DOUBLE) AS `{c}`" if c in have else f"0D AS `{c}`" for c in expected]
    return df.selectExpr(*[f"`{c}`" for c in extra if c in have], *cols)


def clean_features(df: DataFrame, expected=FEATURES, inf_policy="zero"):
    """Coerce and clean every present feature column; only text needs parsing."""
    present = set(present_features(df, expected))
    numbers, cleaned = [], []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if field.name not in present:
            numbers.append(name)
            cleaned.append(name)
            continue
        number = number_sql(name) if isinstance(field.dataType, StringType) else f"CAST({name} AS DOUBLE)"
        numbers.append(f"{number} AS {name}")
        cleaned.append(f"{clean_sql(name, inf_policy)} AS {name}")
    # Two projections, so that each text is parsed once and not at every use.
    return df.selectExpr(*numbers).selectExpr(*cleaned)
