"""Constants as SQL text. One parsed expression is built much faster than many column calls."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value) -> str:
    """A Python constant as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        if math.isinf(value) or math.isnan(value):
            return f"double('{value}')"
        return f"{value!r}D"
    return str(value)


def literal_map(mapping, value_type=None) -> Column:
    """A constant map column; the optimizer folds it into the plan."""
    cast = f"CAST({{}} AS {value_type})" if value_type else "{}"
    cells = [f"{sql_text(k)}, {cast.format(sql_text(v))}" for k, v in mapping.items()]
    return F.expr(f"map({', '.join(cells)})")


def literal_array(values) -> Column:
    return F.expr(f"array({', '.join(sql_text(v) for v in values)})")
