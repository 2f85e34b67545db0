"""Repeatable sampling: every choice is a function of a seed and the row's id."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.labels import encode_label, label_name
from flowspark.functions.literals import literal_array
from flowspark.operators.ordering import HOT_ROWS, with_row_index
from flowspark.schema import MASK_RATE
from flowspark.session import materialise

_UNIT = 2 ** 32
CHUNK = 10_000


def hash_hex(seed, *cols):
    """32 hex digits from the seed and the given columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_number(seed, *cols):
    """Uniform whole number below 2**32 from the first eight digits of hash_hex."""
    return F.conv(F.substring(hash_hex(seed, *cols), 1, 8), 16, 10).cast("bigint")


def hash_long(seed, *cols):
    """Uniform whole number below 2**60."""
    return F.conv(F.substring(hash_hex(seed, *cols), 1, 15), 16, 10).cast("bigint")


def hash_unit(seed, *cols):
    """Uniform number in [0, 1)."""
    return hash_number(seed, *cols) / F.lit(float(_UNIT))


def capped_sample(df: DataFrame, n, group, id_column, seed=42):
    """At most n rows per group: the first n in hash order.

    One pass counts rows by (group, leading zero bits of the hash). The most zeros that still leave n
    rows become the group's cut, and only rows below it are ranked: about 2n of them, however large
    the group is. The cuts are a row for each group and written, so that Spark knows their size before
    it picks the form of the join: a few cuts go to the rows, which then stay where they are.
    """
    group = list(group)
    hashed = df.withColumn("_h", hash_hex(seed, id_column)).withColumn(
        "_u", F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
    )
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    zeros = F.expr("CASE WHEN _u = 0 THEN 32 ELSE 32 - length(bin(_u)) END")
    counted = hashed.groupBy(*keys, zeros.alias("_zeros")).agg(F.count(F.lit(1)).alias("_n"))
    # at most 33 rows a group
    of_group = Window.partitionBy(*names)
    left = F.sum("_n").over(of_group.orderBy(F.col("_zeros").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    enough = counted.select(*names, "_zeros", left.alias("_left"), F.sum("_n").over(of_group).alias("_total")).filter(
        F.col("_left") >= F.least(F.lit(n), F.col("_total")))
    cuts = enough.groupBy(*names).agg(F.expr("shiftleft(1L, 32 - CAST(max(_zeros) AS INT))").alias("_cut"))
    cuts = materialise(cuts, "cuts")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    candidates = hashed.join(cuts, same).filter(F.col("_u") < F.col("_cut"))
    ranked = Window.partitionBy(*group).orderBy("_h", id_column)
    return (
        candidates.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= n)
        .select(*df.columns)
    )


def class_pool(df: DataFrame, n=5000, raw_label="label", id_column="flow_id", seed=42):
    """At most n rows per canonical class; spellings of a class share its cap."""
    pooled = df.withColumn("class_name", label_name(encode_label(F.col(raw_label))))
    return capped_sample(pooled, n, ["class_name"], id_column, seed)


def first_exemplars(df: DataFrame, size=20, file="source_file", label="label_id", order="flow_id", targets=None):
    """The first `size` rows of each target class from the first file that holds enough of them."""
    if targets is not None:
        df = df.filter(F.col(label).isin(list(targets)))
    per_file = df.groupBy(file, label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= size)
    chosen = per_file.groupBy(label).agg(F.min(file).alias(file))
    # One file per class: no more rows than there are classes.
    rows = df.join(F.broadcast(chosen), [label, file], "left_semi")
    first = Window.partitionBy(label).orderBy(order)
    return rows.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= size).drop("_rank")


def stratified_split(df: DataFrame, label="label_id", id_column="flow_id", train=70, val=15, seed=42,
                     hot_rows=HOT_ROWS):
    """Add `split` (train / val / test) with exact per-class shares given in percent.

    When a class has a single row the whole table is split at once, without strata.
    """
    smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first()["n"]
    keys = [label] if smallest is not None and smallest >= 2 else []
    ranked = with_row_index(
        df.withColumn("_h", hash_number(seed, id_column)), keys, "_h", id_column, "_r", total="_n",
        hot_rows=hot_rows,
    )
    # Whole numbers throughout: the held-out part is rounded up, then its test part.
    rest = F.expr(f"(_n * {100 - train} + 99) div 100")
    test = F.expr(f"(((_n * {100 - train} + 99) div 100) * {100 - train - val} + {100 - train - 1}) div {100 - train}")
    split = (
        F.when(F.col("_r") < F.col("_n") - rest, "train")
        .when(F.col("_r") < F.col("_n") - test, "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_h", "_r", "_n")


def class_totals(df: DataFrame, label="label_id"):
    """{class: rows} on the driver; a class dimension has few rows by contract."""
    rows = df.groupBy(label).agg(F.count("*").alias("n")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError(f"{label} has more than 10000 values; it is not a class column")
    return {r[label]: r["n"] for r in rows}


def balanced_resample(df: DataFrame, label="label_id", id_column="flow_id", seed=42, size=None, chunk=CHUNK,
                      hot_rows=HOT_ROWS):
    """Draw `size` rows with replacement, every class equally likely and every row of a class; size is exact.

    Without a size as many rows are drawn as there are. Draw j takes the class and the row's place in
    its class, by id, from hashes of j, so repeated tasks draw the same. `copy` numbers the draws of a row.
    Draws are counted per row before they meet it, so a rare class costs its rows; rows with many copies
    are cut into chunks and spread over the tasks.
    """
    totals = class_totals(df, label)
    if not totals:
        return df.withColumn("copy", F.lit(0).cast("bigint"))
    classes = sorted(totals, key=lambda c: (c is None, c))
    size = sum(totals.values()) if size is None else size
    rows_of = literal_array([totals[c] for c in classes])
    draws = df.sparkSession.range(size).withColumn("_class", (hash_long(f"{seed}|class", "id") % len(classes)).cast("int"))
    draws = draws.withColumn("_place", hash_long(f"{seed}|row", "id") % F.element_at(rows_of, F.col("_class") + 1))
    drawn = draws.groupBy("_class", "_place").agg(F.count(F.lit(1)).alias("_copies"))
    number = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(c)), i) for i, c in enumerate(classes)])
    placed = with_row_index(df, [label], id_column, id_column, "_place", hot_rows=hot_rows).withColumn("_class", number)
    out = placed.join(drawn, ["_class", "_place"])
    many = size / len(classes) / min(totals.values()) > chunk
    if many:
        out = out.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {chunk}"))))
        out = out.repartition(F.col(id_column), F.col("_chunk"))
    else:
        out = out.withColumn("_chunk", F.lit(0).cast("bigint"))
    first = F.col("_chunk") * chunk
    last = F.least(first + chunk, F.col("_copies")) - 1 if many else F.col("_copies") - 1
    return out.withColumn("copy", F.explode(F.sequence(first, last))).drop("_class", "_place", "_copies", "_chunk")


def mask_fields(session_flows: DataFrame, features, keys=("host", "session_idx", "pos"), rate=MASK_RATE, seed=42):
    """Long form of a masked copy: key, field, value (0 where masked), target (the original, else null).

    Only real flows have rows, so padding is never masked.
    """
    melted = session_flows.unpivot(list(keys), list(features), "field", "original")
    limit = int(rate * _UNIT)
    masked = hash_number(seed, *keys, "field") < limit
    return melted.withColumn("masked", masked).select(
        *keys, "field", "masked",
        F.when(F.col("masked"), F.lit(0.0)).otherwise(F.col("original")).alias("value"),
        F.when(F.col("masked"), F.col("original")).alias("target"),
    )


def next_event_pairs(session_flows: DataFrame, features, keys=("host", "session_idx")):
    """Per session with more than one flow: the flows before the last as context, the last as target."""
    flow = F.struct(F.col("pos"), F.array(*[F.col(c).cast("double") for c in features]).alias("features"))
    nested = session_flows.groupBy(*keys).agg(F.array_sort(F.collect_list(flow)).alias("flows"))
    n = F.size("flows")
    vectors = F.transform(F.col("flows"), lambda f: f["features"])
    return nested.filter(n > 1).select(
        *keys, (n - 1).alias("context_length"),
        F.slice(vectors, F.lit(1), n - 1).alias("context"),
        F.element_at(vectors, -1).alias("target"),
    )


def pad_sessions(nested: DataFrame, length, n_features, keys=("host", "session_idx")):
    """Fixed-length form of session_arrays: features, log_types, padding_mask, length."""
    kept = F.slice(F.col("flows"), 1, length)
    n = F.least(F.size("flows"), F.lit(length))
    missing = F.lit(length) - n
    zeros = F.array_repeat(F.lit(0.0).cast("float"), n_features)
    return nested.select(
        *keys, *[c for c in ("label",) if c in nested.columns],
        F.concat(F.transform(kept, lambda f: f["features"]), F.array_repeat(zeros, missing)).alias("features"),
        F.concat(F.transform(kept, lambda f: f["log_type"]), F.array_repeat(F.lit(0), missing)).alias("log_types"),
        F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i >= n).alias("padding_mask"),
        n.alias("length"),
    )
