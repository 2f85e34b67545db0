"""Which flows and features a session's result rests on."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.scores import attention_entropy
from flowspark.operators.ordering import evenly, with_row_index
from flowspark.operators.sampling import hash_hex, hash_unit

#: Rows whose copies, one for each column, one task scores.
COPIED_ROWS = 10_000


def event_weights(session_flows: DataFrame, scaler, keys=("host", "session_idx")):
    """Weight of each flow in its session: squared standardised distance over the session's sum.

    A session of identical average flows gives equal weights.
    """
    distance = F.expr(" + ".join(f"pow({scaler.scaled_sql(c)}, 2)" for c in scaler.columns))
    session = Window.partitionBy(*keys)
    total, n = F.sum("_d").over(session), F.count("*").over(session)
    weight = F.when(total > 0, F.col("_d") / total).otherwise(F.lit(1.0) / n)
    return session_flows.select(*keys, "pos", distance.alias("_d")).withColumn("weight", weight).drop("_d")


def top_events(weights: DataFrame, n=5, keys=("host", "session_idx"), digits=12):
    """The n heaviest flows per session; ties by position."""
    ranked = Window.partitionBy(*keys).orderBy(F.round("weight", digits).desc(), "pos")
    return weights.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def weight_entropy(weights: DataFrame, keys=("host", "session_idx")):
    """Entropy of the flow weights of each session."""
    in_order = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "weight"))), lambda e: e["weight"]
    )
    return weights.groupBy(*keys).agg(attention_entropy(in_order).alias("attention_entropy"))


def model_importance(spark, model, names, n=20):
    """The n features with the highest impurity importance of a fitted tree model."""
    values = [float(v) for v in model.featureImportances.toArray()]
    rows = sorted(zip(names, values), key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double")


def sample_rows(df: DataFrame, n, id_column, seed=42):
    """n rows in hash order: a top-n, so no task keeps more than n."""
    return df.orderBy(hash_hex(seed, id_column), id_column).limit(n)


def permutation_importance(scored_by, rows: DataFrame, columns, label, id_column, seed=42):
    """Loss of accuracy when one column is shuffled among all rows.

    scored_by turns rows with the feature columns into rows with `prediction`. All shuffled copies
    are scored in one pass. Two numberings of the rows, by id and in hash order, pair each row with
    another row's values; id_column is a number column.
    """
    here = with_row_index(rows, (), id_column, id_column, "_r")
    drawn = rows.select(F.col(id_column).alias("_id"), hash_unit(seed, id_column).alias("_u"),
                        *[F.col(c).alias(f"_donor_{c}") for c in columns])
    donors = with_row_index(drawn, (), "_u", "_id", "_r").drop("_id", "_u")
    # both numberings and a join of little data leave the rows with few tasks
    paired = evenly(here.join(donors, "_r"), rows.count(), [id_column], COPIED_ROWS)
    names = F.array(F.lit(""), *[F.lit(c) for c in columns])
    copies = paired.withColumn("feature", F.explode(names))
    shuffled = copies.withColumns({
        c: F.when(F.col("feature") == c, F.col(f"_donor_{c}")).otherwise(F.col(c)) for c in columns
    })
    right = (F.col("prediction").cast("int") == F.col(label).cast("int")).cast("double")
    accuracy = scored_by(shuffled).groupBy("feature").agg(F.avg(right).alias("accuracy"))
    base = accuracy.filter("feature = ''").select(F.col("accuracy").alias("_base"), F.lit(1).alias("_one"))
    return accuracy.filter("feature != ''").withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one").select(
        "feature", (F.col("_base") - F.col("accuracy")).alias("importance")
    )


def occlusion(scored_by, rows: DataFrame, columns, means, id_column, n=15):
    """Per row the n features whose replacement by the mean moves the called class's probability most.

    scored_by adds `prediction` (class index) and `probability` (array). All replaced copies of a
    row are scored in one pass.
    """
    names = F.array(F.lit(""), *[F.lit(c) for c in columns])
    copies = evenly(rows, rows.count(), [id_column], COPIED_ROWS).withColumn("feature", F.explode(names))
    values = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])
    replaced = copies.withColumn("value", F.try_element_at(values, F.col("feature"))).withColumns({
        c: F.when(F.col("feature") == c, F.lit(float(means[c]))).otherwise(F.col(c)) for c in columns
    })
    scored = scored_by(replaced).select(id_column, "feature", "value", "prediction", "probability")
    called = scored.filter("feature = ''").select(
        id_column, F.col("prediction").cast("int").alias("_class"),
        F.get(F.col("probability"), F.col("prediction").cast("int")).alias("_base"),
    )
    moved = scored.filter("feature != ''").join(called, id_column).select(
        id_column, "feature", "value",
        (F.col("_base") - F.get(F.col("probability"), F.col("_class"))).alias("importance"),
    )
    ranked = Window.partitionBy(id_column).orderBy(F.abs(F.col("importance")).desc(), "feature")
    return moved.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)
