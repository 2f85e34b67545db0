"""Dense row numbers per key that survive a key holding a large share of all rows.

A plain window sorts all rows of a key in one task. Here keys above `hot_rows` are cut into
order slices (quantiles of the order column over the hot keys): each slice is numbered on its
own and shifted by the number of rows in the key's earlier slices. Numbers are exactly those of
the plain window.
"""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 2_000_000
MAX_HOT_KEYS = 100_000
MAX_SLICES = 4096
#: Rows of a part that one task is given, where work passes over a table many times.
PART_ROWS = 250_000

_INF = float("inf")


def with_row_index(df: DataFrame, keys, order, tie, name="row_index", total=None, hot_rows=HOT_ROWS,
                   max_slices=MAX_SLICES):
    """Add a 0-based BIGINT `name`: the position within `keys` by (`order`, `tie`).

    keys may be empty, which numbers the whole table. order is a timestamp or number column,
    tie a number column that makes the order total; both without nulls. total names a further
    column for the number of rows of the key.
    """
    stand_ins = _stand_ins(df, keys)
    keyed, plain_keys = df.withColumns(stand_ins) if stand_ins else df, list(keys)
    keys = list(stand_ins)
    plan = _hot_plan(keyed, keys, order, tie, hot_rows, max_slices)
    if plan is None:
        by = Window.partitionBy(*(plain_keys or [F.lit(0)]))
        out = df.withColumn(name, (F.row_number().over(by.orderBy(order, tie)) - 1).cast("bigint"))
        return out.withColumn(total, F.count("*").over(by)) if total else out

    hot, order_edges, tie_edges, heavy_values = plan
    sliced = _slice(keyed, keys, order, tie, hot, order_edges, tie_edges, heavy_values)
    cells = keys + ["_slice", "_subslice"]
    sizes = sliced.filter("_hot").groupBy(*cells).agg(F.count("*").alias("_n"))
    # At most len(order_edges) * len(tie_edges) rows per hot key.
    key = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = key.orderBy("_slice", "_subslice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *cells,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(key).alias("_key_rows"),
    )
    # A cell is one slice of a hot key or the whole of any other key.
    cell = Window.partitionBy(*cells)
    out = sliced.join(offsets, cells, "left").withColumn(
        name, (F.row_number().over(cell.orderBy(order, tie)) - 1 + F.coalesce("_before", F.lit(0))).cast("bigint")
    )
    added = [name]
    if total:
        out = out.withColumn(total, F.coalesce(F.col("_key_rows"), F.count("*").over(cell)))
        added.append(total)
    return out.select(*df.columns, *added)


def evenly(df: DataFrame, n_rows, keys, part_rows=PART_ROWS):
    """df in parts of about part_rows rows, dealt by the hash of keys and in their order; as it is if one part holds all."""
    if n_rows <= part_rows:
        return df
    return df.repartition(-(-n_rows // part_rows), *keys).sortWithinPartitions(*keys)


def _stand_ins(df, keys):
    """Key columns without nulls (value and null flag), so that joins and windows treat null as a key."""
    columns = {}
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        value = F.col(key) if isinstance(kind, T.NumericType) else F.col(key).cast("string")
        default = F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("")
        columns[f"_key{i}"] = F.coalesce(value, default)
        columns[f"_null{i}"] = F.col(key).isNull()
    return columns


def _as_number(df, column):
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # Wall-clock micros without a time zone, so that no clock change reorders rows.
        seconds = F.unix_date(value.cast("date")) * F.lit(86400).cast("bigint") + F.hour(value) * 3600
        seconds = seconds + F.minute(value) * 60
        return (seconds * 1000000 + F.date_part(F.lit("SECOND"), value) * 1000000).cast("double")
    return value.cast("double")


def _hot_plan(df, keys, order, tie, hot_rows, max_slices):
    """None when no key is hot, else the hot keys and the slice edges (all of bounded size)."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    totals = per_key.agg(F.sum("_n").alias("rows"), F.max("_n").alias("largest")).first()
    if totals["largest"] is None or totals["largest"] <= hot_rows:
        return None
    # At most MAX_HOT_KEYS keys can hold more than rows / MAX_HOT_KEYS rows each.
    limit = max(hot_rows, totals["rows"] // MAX_HOT_KEYS)
    hot = per_key.filter(F.col("_n") > limit).select(*keys) if keys else None
    hot_df = df.join(F.broadcast(hot), keys, "left_semi") if keys else df

    n_slices = int(min(max_slices, max(2, -(-totals["rows"] // max(1, limit // 2)))))
    grid = [i / n_slices for i in range(1, n_slices)]
    accuracy = n_slices * 10
    cuts = hot_df.agg(F.percentile_approx(_as_number(df, order), grid, accuracy).alias("cuts")).first()["cuts"]
    # An order value met twice holds at least one whole slice: isolate it and cut it by tie. Above
    # 2**53 different whole numbers may share a double, so those stay in one slice.
    heavy = sorted({b for a, b in zip(cuts, cuts[1:]) if a == b and abs(b) < 2 ** 53})
    order_edges = sorted({*cuts, *[_next_up(v) for v in heavy]})
    tie_edges = []
    if heavy:
        at_heavy = _as_number(df, order).isin(heavy)
        tie_edges = sorted(set(
            hot_df.filter(at_heavy)
            .agg(F.percentile_approx(_as_number(df, tie), grid, accuracy).alias("cuts")).first()["cuts"]
        ))
    return hot, order_edges, tie_edges, heavy


def _next_up(value):
    """Smallest edge above an order value (micros and ids are whole numbers below 2**53)."""
    return math.nextafter(value, _INF)


def _bucket(df, source, edges, name):
    return Bucketizer(splits=[-_INF, *edges, _INF], inputCol=source, outputCol=name).transform(df)


def _slice(df, keys, order, tie, hot, order_edges, tie_edges, heavy):
    out = df.withColumns({"_order": _as_number(df, order), "_tie": _as_number(df, tie)})
    if keys:
        out = out.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
        out = out.withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    else:
        out = out.withColumn("_hot", F.lit(True))
    out = _bucket(out, "_order", order_edges, "_slice")
    if tie_edges:
        out = _bucket(out, "_tie", tie_edges, "_subslice")
        cut = F.col("_hot") & F.col("_order").isin(heavy)
    else:
        out = out.withColumn("_subslice", F.lit(0.0))
        cut = F.lit(False)
    return out.withColumns({
        "_slice": F.when(F.col("_hot"), F.col("_slice")).otherwise(0.0).cast("int"),
        "_subslice": F.when(cut, F.col("_subslice")).otherwise(0.0).cast("int"),
    }).drop("_order", "_tie")
