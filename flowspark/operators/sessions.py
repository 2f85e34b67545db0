"""Count windows ("sessions") over the flows of a host, and their labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.labels import label_name
from flowspark.operators.ordering import HOT_ROWS, with_row_index
from flowspark.schema import N_CLASSES, SESSION_SIZE, TRUNCATION_POINTS

#: Stands for every label id that is none of the known classes; it counts as an attack.
OTHER_CLASS = N_CLASSES


def sessionize(flows: DataFrame, size=SESSION_SIZE, stride=None, keys=("host",), order="ts", tie="flow_id",
               hot_rows=HOT_ROWS):
    """Long form of count windows: each flow with its session_idx and pos, once per window it is in.

    Windows start every `stride` flows and hold `size` flows; a window that the last flows do not
    fill is dropped. keys=() gives one sequence over the whole table.
    """
    stride = stride or size
    out = with_row_index(flows, keys, order, tie, "_i", total="_total", hot_rows=hot_rows)
    i = F.col("_i")
    if stride < size:
        first = F.when(i < size, F.lit(0)).otherwise(F.expr(f"(_i - {size} + {stride}) div {stride}"))
        windows = F.sequence(first.cast("bigint"), F.expr(f"_i div {stride}"))
        out = out.withColumn("session_idx", F.explode(windows))
    else:
        if stride > size:
            out = out.filter(i % stride < size)
        out = out.withColumn("session_idx", F.expr(f"_i div {stride}"))
    start = F.col("session_idx") * stride
    return (
        out.filter(start + size <= F.col("_total"))
        .withColumn("pos", (i - start).cast("int"))
        .drop("_i", "_total")
    )


def benign_sessions(flows: DataFrame, **options):
    """Windows over benign flows only; positions count benign flows."""
    return sessionize(flows.filter(F.col("label_id") == 0), **options)


def class_counts(label="label_id"):
    """One count per class as an array column, for use inside an aggregate; the last is OTHER_CLASS."""
    return F.expr(class_counts_sql(label))


def class_counts_sql(label="label_id"):
    known = [f"count_if({label} = {c})" for c in range(N_CLASSES)]
    return f"array({', '.join(known)}, count_if({label} NOT BETWEEN 0 AND {N_CLASSES - 1}))"


def majority_label(counts):
    """Most frequent class; with any attack present, the most frequent attack. Ties: lowest id.

    Null when no flow has a label.
    """
    attacks = F.slice(counts, 2, N_CLASSES)
    top = F.array_max(attacks)
    benign = F.when(F.element_at(counts, 1) > 0, 0)
    return F.when(top > 0, F.array_position(attacks, top)).otherwise(benign).cast("int")


def attack_ids(counts):
    """Sorted ids of the attack classes with a non-zero count, OTHER_CLASS among them."""
    ids = F.sequence(F.lit(1), F.lit(OTHER_CLASS))
    return F.filter(ids, lambda c: F.element_at(counts, c + 1) > 0)


def session_summary(session_flows: DataFrame, keys=("host", "session_idx"), label="label_id"):
    """One row per session: label, has_attack, attack_ids, n_flows."""
    counts = session_flows.groupBy(*keys).agg(
        class_counts(label).alias("_counts"), F.count("*").cast("int").alias("n_flows")
    )
    return counts.select(
        *keys,
        majority_label(F.col("_counts")).alias("label"),
        (F.size(attack_ids(F.col("_counts"))) > 0).alias("has_attack"),
        attack_ids(F.col("_counts")).alias("attack_ids"),
        "n_flows",
    )


def session_truth(session_flows: DataFrame, keys=("host", "session_idx"), label="label_id"):
    """Live-path truth: most frequent class (first seen wins ties), any-attack flag, name -> count."""
    keys = list(keys)
    per_label = session_flows.groupBy(*keys, label).agg(
        F.count("*").alias("_n"), F.min("pos").alias("_first")
    )
    # A map takes no null key.
    name = F.coalesce(label_name(F.col(label)), F.lit("Unknown"))
    return per_label.groupBy(*keys).agg(
        F.max_by(F.col(label), F.struct(F.col("_n"), -F.col("_first"))).cast("int").alias("majority_id"),
        F.bool_or(F.col(label) != 0).alias("has_attack"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(name.alias("name"), F.col("_n").alias("n"))
        ))).alias("distribution"),
        F.sum("_n").cast("int").alias("n_flows"),
    ).withColumn("majority_name", label_name(F.col("majority_id")))


def truncate_sessions(session_flows: DataFrame, points=tuple(TRUNCATION_POINTS), name="n"):
    """Each session cut to its first n flows, for every n; flows keep the labels they have.

    A flow at position p belongs to every cut n > p, so rows repeat at most len(points) times.
    """
    cuts = F.array(*[F.lit(n) for n in points])
    return session_flows.withColumn(name, F.explode(F.filter(cuts, lambda n: n > F.col("pos"))))


def session_arrays(session_flows: DataFrame, features, keys=("host", "session_idx"), label="label_id"):
    """Nested form: one row per session with its flows as an array ordered by pos.

    Only for windows of bounded size; the long form is the working format.
    """
    flow = F.struct(
        F.col("pos"), F.col("log_type").cast("int").alias("log_type"),
        F.array(*[F.col(c).cast("float") for c in features]).alias("features"),
    )
    nested = session_flows.groupBy(*keys).agg(
        class_counts(label).alias("_counts"),
        F.array_sort(F.collect_list(flow)).alias("flows"),
    )
    return nested.select(
        *keys, majority_label(F.col("_counts")).alias("label"),
        (F.size(attack_ids(F.col("_counts"))) > 0).alias("has_attack"),
        attack_ids(F.col("_counts")).alias("attack_ids"), "flows",
    )


def flow_rows_with_session_label(session_flows: DataFrame, keys=("host", "session_idx"), label="label_id"):
    """Per-flow rows carrying their session's label."""
    keys = list(keys)
    labels = session_summary(session_flows, keys, label).select(*keys, F.col("label").alias("session_label"))
    return session_flows.join(labels, keys)


def five_minute_windows(flows: DataFrame, duration="5 minutes", watermark=None):
    """Host and time-bucket windows; with a watermark the same plan runs on a stream."""
    if watermark:
        flows = flows.withWatermark("ts", watermark)
    grouped = flows.groupBy("host", F.window("ts", duration).alias("w"))
    counted = grouped.agg(
        F.count("*").alias("n_flows"),
        class_counts().alias("_counts"),
        F.sum(F.col("total_length_of_fwd_packets") + F.col("total_length_of_bwd_packets")).alias("total_bytes"),
    )
    return counted.select(
        "host", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_flows",
        majority_label(F.col("_counts")).alias("label"),
        (F.size(attack_ids(F.col("_counts"))) > 0).alias("has_attack"), "total_bytes",
    )
