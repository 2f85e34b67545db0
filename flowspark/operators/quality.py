"""Checks and distributions of a flow table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.labels import label_name
from flowspark.functions.literals import sql_text
from flowspark.functions.protocol import log_type_name
from flowspark.functions.text import schema_hash
from flowspark.schema import LABELS, LOG_TYPE_NAMES, N_CLASSES, SESSION_SIZE


def cell_report(df: DataFrame, columns):
    """column, nan_count, inf_count per column from a single pass; null counts as NaN."""
    aggs = []
    for i, c in enumerate(columns):
        value = f"CAST(`{c}` AS DOUBLE)"
        aggs.append(F.expr(f"count_if({value} IS NULL OR isnan({value}))").alias(f"n{i}"))
        aggs.append(F.expr(f"count_if(abs({value}) = double('inf'))").alias(f"f{i}"))
    rows = ", ".join(f"{sql_text(c)}, n{i}, f{i}" for i, c in enumerate(columns))
    return df.agg(*aggs).selectExpr(f"stack({len(columns)}, {rows}) AS (column, nan_count, inf_count)")


def schema_report(df: DataFrame, expected, label="label_id"):
    """One row per finding about column names and types: missing, extra, not numeric."""
    have = {f.name: f.dataType for f in df.schema.fields}
    found = [("missing", c) for c in expected if c not in have]
    found += [("extra", c) for c in have if c not in set(expected) and c != label]
    found += [
        ("not_numeric", c) for c in expected if c in have and not isinstance(have[c], T.NumericType)
    ]
    if label not in have:
        found.append(("label_missing", label))
    return df.sparkSession.createDataFrame(found, "finding string, column string")


def name_differences(df: DataFrame, saved_names: DataFrame):
    """Names in a saved schema and not in the table, and the reverse, by anti joins."""
    current = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    saved = saved_names.select("name")
    missing = saved.join(current, "name", "left_anti").withColumn("finding", F.lit("missing"))
    extra = current.join(saved, "name", "left_anti").withColumn("finding", F.lit("extra"))
    return missing.unionByName(extra)


def validation_report(df: DataFrame, expected, label="label_id"):
    """Tidy report (check, column, count): schema findings, bad cells and row count."""
    present = [c for c in expected if c in df.columns]
    findings = schema_report(df, expected, label).select(
        F.col("finding").alias("check"), "column", F.lit(1).cast("bigint").alias("count")
    )
    cells = cell_report(df, present)
    bad = cells.select(F.explode(F.array(
        F.struct(F.lit("nan").alias("check"), "column", F.col("nan_count").alias("count")),
        F.struct(F.lit("inf").alias("check"), "column", F.col("inf_count").alias("count")),
    )).alias("r")).select("r.*").filter("count > 0")
    rows = df.agg(F.count("*").alias("count")).select(F.lit("rows").alias("check"), F.lit("*").alias("column"), "count")
    return findings.unionByName(bad).unionByName(rows)


def schema_fingerprint(df: DataFrame):
    """One row: the schema hash of the table's column names."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.sparkSession.range(1).select(schema_hash(names).alias("schema_hash"))


def split_by_size(session_flows: DataFrame, keys=("host", "session_idx"), size=SESSION_SIZE):
    """(sessions of the right size, the others) as session-level tables with n_flows."""
    sizes = session_flows.groupBy(*keys).agg(F.count("*").cast("int").alias("n_flows"))
    return sizes.filter(F.col("n_flows") == size), sizes.filter(F.col("n_flows") != size)


def fits_request(n_flows, max_flows):
    """Whether a request has flows and not more than allowed."""
    return (n_flows > 0) & (n_flows <= max_flows)


def split_requests(flows: DataFrame, max_flows, key="request_id"):
    """(accepted, rejected) requests by number of flows; an empty request has one row of null features."""
    sizes = flows.groupBy(key).agg(F.count("features").alias("n_flows"))
    ok = fits_request(F.col("n_flows"), max_flows)
    return sizes.filter(ok), sizes.filter(~ok)


def log_type_distribution(df: DataFrame):
    return df.groupBy("log_type").agg(F.count("*").alias("n")).select(
        log_type_name(F.col("log_type")).alias("log_type_name"), "n"
    )


def log_type_map(df: DataFrame, keys):
    """Log-type name -> count per key, from counters held inside one aggregate."""
    return df.groupBy(*keys).agg(*log_type_counts()).select(*keys, present_log_types().alias("log_type_distribution"))


def log_type_counts():
    """One count per log type, for use inside an aggregate; a column for each name."""
    return [F.count_if(F.col("log_type") == code).alias(name) for code, name in LOG_TYPE_NAMES.items()]


def present_log_types():
    """The map of the log types that occur, from the columns of log_type_counts."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in LOG_TYPE_NAMES.values()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


def label_counts(df: DataFrame, label="label_id"):
    """Rows per class: all known classes, absent ones as 0, and any other id or null that occurs."""
    found = df.groupBy(F.col(label).cast("int").alias("label_id")).agg(F.count("*").alias("n"))
    known = df.sparkSession.range(N_CLASSES).select(F.col("id").cast("int").alias("label_id"), F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(known).groupBy("label_id").agg(F.sum("n").alias("n"))


def label_distribution(df: DataFrame, label="label_id", min_samples=2):
    """Per class: name, count, share and whether it is empty or rare."""
    # One row per class, so the window over all of them is small.
    everything = Window.partitionBy(F.lit(1))
    return label_counts(df, label).select(
        "label_id", label_name(F.col("label_id")).alias("label_name"), "n",
        (F.col("n") / F.greatest(F.sum("n").over(everything), F.lit(1))).alias("share"),
        (F.col("n") == 0).alias("is_empty"),
        ((F.col("n") > 0) & (F.col("n") < min_samples)).alias("is_rare"),
    )


def label_balance(df: DataFrame, label="label_id", min_samples=2, warn_ratio=1000):
    """One row: totals, empty and rare classes, imbalance ratio (null with one class) and its warning."""
    n = F.col("n")
    present = F.when(n > 0, n)
    ratio = F.max(present) / F.min(present)
    several = F.count_if(n > 0) > 1
    return label_counts(df, label).agg(
        F.sum("n").alias("total_samples"),
        F.count_if(n > 0).alias("num_classes_present"),
        F.lit(len(LABELS)).cast("bigint").alias("num_classes_expected"),
        F.array_sort(F.collect_list(F.when(n == 0, F.col("label_id")))).alias("empty_classes"),
        F.array_sort(F.collect_list(F.when((n > 0) & (n < min_samples), F.col("label_id")))).alias("rare_classes"),
        F.when(several, F.round(ratio, 1)).alias("imbalance_ratio"),
        F.coalesce(several & (ratio > warn_ratio), F.lit(False)).alias("extreme_imbalance"),
    )


def label_distribution_by_file(df: DataFrame, file="source_file", label="label_id"):
    """Rows and percentage of each class within its file."""
    per_class = df.groupBy(file, label).agg(F.count("*").alias("n"))
    # at most a row per class and file
    total = F.sum("n").over(Window.partitionBy(file))
    return per_class.select(
        file, label, label_name(F.col(label)).alias("label_name"), "n", (F.col("n") * 100 / total).alias("percent"),
    )
