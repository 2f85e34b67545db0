"""Detection metrics from (y_true, y_pred, probs) rows.

Everything starts from counts that tasks combine before the shuffle: the confusion matrix has at
most 15 x 15 cells, score curves one row per distinct rounded score.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.labels import label_name
from flowspark.functions.literals import literal_map
from flowspark.functions.scores import attack_score, confidence
from flowspark.functions.text import comparison_line
from flowspark.schema import LABELS, N_CLASSES, STAGES, STAT_NAMES, THRESHOLDS

DIGITS = 9
CURVE_SLICES = 4096


def _ratio(top, bottom):
    """top / bottom, 0 when there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


# ---- counts ------------------------------------------------------------------------------------

def confusion_counts(preds: DataFrame, by=()):
    """Non-empty confusion cells: [by], y_true, y_pred, n."""
    return preds.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame):
    """All 15 x 15 cells, absent pairs as 0."""
    spark = preds.sparkSession
    grid = spark.range(N_CLASSES * N_CLASSES).select(
        F.expr(f"cast(id div {N_CLASSES} as int)").alias("y_true"),
        F.expr(f"cast(id % {N_CLASSES} as int)").alias("y_pred"),
        F.lit(0).cast("bigint").alias("n"),
    )
    cells = confusion_counts(preds).select(F.col("y_true").cast("int"), F.col("y_pred").cast("int"), "n")
    return cells.unionByName(grid).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def confusion_pivot(preds: DataFrame):
    """One row per true class, one column p0..p14 per predicted class."""
    return confusion_matrix(preds).groupBy("y_true").agg(*[
        F.sum(F.when(F.col("y_pred") == c, F.col("n")).otherwise(0)).alias(f"p{c}") for c in range(N_CLASSES)
    ])


def class_counts_from(cells: DataFrame, by=(), all_classes=False):
    """[by], class_id, support, predicted, hits from confusion cells."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")

    def part(class_id, support, predicted, hits):
        return F.struct(class_id.cast("int").alias("class_id"), support.alias("support"),
                        predicted.alias("predicted"), hits.alias("hits"))

    parts = F.array(part(F.col("y_true"), F.col("n"), zero, hit), part(F.col("y_pred"), zero, F.col("n"), zero))
    rows = cells.select(*by, F.explode(parts).alias("c")).select(*by, "c.*")
    if all_classes:
        spark = cells.sparkSession
        rows = rows.unionByName(spark.range(N_CLASSES).select(
            F.col("id").cast("int").alias("class_id"),
            zero.alias("support"), zero.alias("predicted"), zero.alias("hits"),
        ))
    return rows.groupBy(*by, "class_id").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )


def _with_scores(classes):
    support, predicted, hits = F.col("support"), F.col("predicted"), F.col("hits")
    return classes.withColumns({
        "precision": _ratio(hits, predicted),
        "recall": _ratio(hits, support),
        "f1": _ratio(2 * hits, support + predicted),
    })


# ---- summary metrics -----------------------------------------------------------------------------

def summary_metrics(preds: DataFrame, by=()):
    """One row per `by`: accuracy, weighted and macro scores, sample counts.

    The macro F1 averages over the classes met in truth or prediction.
    """
    scored = _with_scores(class_counts_from(confusion_counts(preds, by), by))
    support = F.col("support")
    n = F.sum("support")

    def weighted(name):
        return _ratio(F.sum(F.col(name) * support), n)

    return scored.groupBy(*by).agg(
        _ratio(F.sum("hits"), n).alias("accuracy"),
        weighted("f1").alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        n.alias("n_samples"),
        F.sum(F.when(F.col("class_id") != 0, support).otherwise(0)).alias("n_attacks"),
        F.sum(F.when(F.col("class_id") == 0, support).otherwise(0)).alias("n_benign"),
    )


def class_report(preds: DataFrame):
    """Precision, recall, F1 and support per class for all classes, then accuracy, macro and weighted rows."""
    scored = _with_scores(class_counts_from(confusion_counts(preds), all_classes=True))
    support, n = F.col("support"), F.sum("support")
    per_class = scored.select(label_name(F.col("class_id")).alias("class"), "precision", "recall", "f1", "support")
    accuracy = _ratio(F.sum("hits"), n)
    totals = scored.agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[_ratio(F.sum(F.col(c) * support), n).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        accuracy.alias("acc"), n.alias("n"),
    )

    def row(name, *cells):
        names = ("precision", "recall", "f1")
        return F.struct(F.lit(name).alias("class"), *[F.col(c).alias(a) for c, a in zip(cells, names)],
                        F.col("n").alias("support"))

    summary = totals.select(F.explode(F.array(
        row("accuracy", "acc", "acc", "acc"),
        row("macro avg", "m_precision", "m_recall", "m_f1"),
        row("weighted avg", "w_precision", "w_recall", "w_f1"),
    )).alias("r")).select("r.*")
    return per_class.unionByName(summary)


def detection_rates(preds: DataFrame):
    """Per attack class met in the truth: count, detected, rate, false positives and their rate."""
    classes = class_counts_from(confusion_counts(preds))
    everything = Window.partitionBy(F.lit(1))
    others = F.sum("support").over(everything) - F.col("support")
    false_positives = F.col("predicted") - F.col("hits")
    return classes.select(
        "class_id", label_name(F.col("class_id")).alias("attack_name"),
        F.col("support").alias("true_count"), F.col("hits").alias("detected_count"),
        F.round(_ratio(F.col("hits"), F.col("support")), 4).alias("detection_rate"),
        false_positives.alias("false_positives"),
        F.round(false_positives / F.greatest(others, F.lit(1)), 6).alias("fp_rate"),
    ).filter((F.col("class_id") != 0) & (F.col("true_count") > 0))


def binary_metrics(preds: DataFrame, by=()):
    """Attack against benign: counts, accuracy, precision, recall, F1, false-positive rate."""
    truth, call = F.col("y_true") != 0, F.col("y_pred") != 0
    return preds.groupBy(*by).agg(
        F.count_if(truth & call).alias("tp"), F.count_if(~truth & call).alias("fp"),
        F.count_if(truth & ~call).alias("fn"), F.count_if(~truth & ~call).alias("tn"),
    ).withColumns(binary_rates())


def binary_rates():
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": _ratio(fp, fp + tn),
    }


# ---- score curves ----------------------------------------------------------------------------------

def score_counts(scored: DataFrame, by=(), digits=DIGITS):
    """Distinct rounded scores with positives and negatives, from (by, score, positive) rows."""
    return scored.groupBy(*by, F.round("score", digits).alias("score")).agg(
        F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )


def cumulate_scores(points: DataFrame, by=(), slices=CURVE_SLICES):
    """Add pos_above / neg_above (rows with a higher score) and the totals per group.

    Scores lie in [0, 1]. Each group is summed in `slices` score ranges that are then shifted by
    the ranges above them, so no task sees more than one range: with 9 digits and 4096 ranges that
    is at most 250 thousand distinct scores.
    """
    by = list(by)
    points = points.withColumn(
        "_slice", F.least(F.floor(F.col("score") * slices), F.lit(slices - 1)).cast("int")
    )
    sums = points.groupBy(*by, "_slice").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    group = Window.partitionBy(*(by or [F.lit(1)]))
    higher = group.orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *by, "_slice",
        F.coalesce(F.sum("_p").over(higher), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_n0"),
        F.sum("_p").over(group).alias("total_pos"), F.sum("_n").over(group).alias("total_neg"),
    )
    within = (
        Window.partitionBy(*by, "_slice").orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return points.join(starts, by + ["_slice"]).select(
        *by, "score", "pos", "neg", "total_pos", "total_neg",
        (F.col("_p0") + F.coalesce(F.sum("pos").over(within), F.lit(0))).alias("pos_above"),
        (F.col("_n0") + F.coalesce(F.sum("neg").over(within), F.lit(0))).alias("neg_above"),
    )


def average_precision(preds: DataFrame, digits=DIGITS):
    """Step-wise area under the precision-recall curve of 1 - P(benign)."""
    scored = preds.select(attack_score(F.col("probs")).alias("score"), (F.col("y_true") != 0).alias("positive"))
    curve = cumulate_scores(score_counts(scored, digits=digits))
    tp = F.col("pos_above") + F.col("pos")
    calls = tp + F.col("neg_above") + F.col("neg")
    step = F.col("pos") / F.col("total_pos") * tp / calls
    return curve.filter("pos > 0").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def one_vs_rest_auc(preds: DataFrame, digits=DIGITS, by=()):
    """Rank-sum AUC per class met in the truth, with its support, and per value of the `by` columns.

    Probabilities are restricted to the classes that a group's truth holds and normalised again per row.
    Classes without negatives give no row. Which classes there are goes into the plan as a table of a row
    for each group, so the curves of all groups and classes come from one aggregate.
    """
    by = list(by)
    one = [F.lit(1).alias("_one")] if not by else []
    keys = by or ["_one"]
    rows = preds.select(*by, *one, "y_true", "probs")
    # at most the known classes in each group; a row of any other class is a negative of all
    inside = F.when(F.col("y_true").between(0, N_CLASSES - 1), F.col("y_true"))
    known = rows.groupBy(*keys).agg(F.collect_set(inside).alias("_classes")).filter(F.size("_classes") > 1)
    marked = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.array_sort("_classes").alias("_classes"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    each = F.transform("_classes", lambda c: F.get("probs", c))
    total = F.greatest(F.aggregate("_inside", F.lit(0.0), lambda a, p: a + F.coalesce(p, F.lit(0.0))), F.lit(1e-10))
    joined = rows.join(marked if by else F.broadcast(marked), same).withColumn("_inside", each).withColumn("_total", total)
    scored = joined.select(*keys, "y_true", "_total", F.explode(F.arrays_zip("_classes", "_inside")).alias("s")).select(
        *keys, F.col("s._classes").cast("int").alias("class_id"), (F.col("s._inside") / F.col("_total")).alias("score"),
        (F.col("y_true") == F.col("s._classes")).alias("positive"))
    curve = cumulate_scores(score_counts(scored, [*keys, "class_id"], digits), [*keys, "class_id"])
    pos, neg = F.col("pos").cast("double"), F.col("neg")
    below = F.col("total_neg") - F.col("neg_above") - neg
    return curve.groupBy(*keys, "class_id").agg(
        F.first("total_pos").alias("support"),
        (F.sum(pos * (below + neg / 2)) / F.first(F.col("total_pos").cast("double") * F.col("total_neg"))).alias("auc"),
    ).select(*by, "class_id", "support", "auc")


def weighted_auc(preds: DataFrame, digits=DIGITS, by=()):
    """One-vs-rest AUC averaged by class support, in one row or one for each value of the `by` columns."""
    mean = (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc_weighted")
    return one_vs_rest_auc(preds, digits, by).groupBy(*by).agg(mean)


def threshold_sweep(preds: DataFrame, thresholds=tuple(THRESHOLDS), digits=DIGITS):
    """Attack / benign quality at each threshold on 1 - P(benign), from one aggregate."""
    rows = preds.select(
        F.round(attack_score(F.col("probs")), digits).alias("score"), (F.col("y_true") != 0).alias("truth")
    )
    score, truth = F.col("score"), F.col("truth")
    aggs = [F.count_if(truth).alias("_p"), F.count_if(~truth).alias("_n")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(truth & (score >= t)).alias(f"tp{i}"), F.count_if(~truth & (score >= t)).alias(f"fp{i}")]
    table = F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                 (F.col("_p") - F.col(f"tp{i}")).alias("fn"), (F.col("_n") - F.col(f"fp{i}")).alias("tn"))
        for i, t in enumerate(thresholds)
    ]))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = F.lit(1)
    tpr = tp / F.greatest(tp + fn, one)
    precision = tp / F.greatest(tp + fp, one)
    return rows.agg(*aggs).select(table.alias("r")).select("r.*").select(
        "threshold",
        F.round(tpr, 4).alias("tpr"),
        F.round(fp / F.greatest(fp + tn, one), 4).alias("fpr"),
        F.round(precision, 4).alias("precision"),
        F.round(tpr, 4).alias("recall"),
        F.round(2 * precision * tpr / F.greatest(precision + tpr, F.lit(1e-9)), 4).alias("f1"),
        "tp", "fp", "fn", "tn",
    )


# ---- reports ---------------------------------------------------------------------------------------

def full_metrics(preds: DataFrame):
    """summary_metrics of one prediction table plus its weighted AUC."""
    auc = weighted_auc(preds).withColumn("_one", F.lit(1))
    return summary_metrics(preds).withColumn("_one", F.lit(1)).join(F.broadcast(auc), "_one", "left").drop("_one")


def flow_evaluation(preds: DataFrame):
    """Per-flow detector report in one row: summary, binary accuracy and F1, average precision."""
    binary = binary_metrics(preds).select(
        F.lit(1).alias("_one"), F.col("accuracy").alias("binary_accuracy"), F.col("f1").alias("binary_f1")
    )
    pr = average_precision(preds).select(F.lit(1).alias("_one"), F.col("average_precision").alias("pr_auc"))
    one_row = summary_metrics(preds).withColumn("_one", F.lit(1))
    return one_row.join(F.broadcast(binary), "_one").join(F.broadcast(pr), "_one").drop("_one")


def compare_configs(preds: DataFrame, auc: DataFrame = None):
    """summary_metrics per config with a fixed-width text row; auc (config, auc_weighted) is optional."""
    table = summary_metrics(preds, ["config"])
    if auc is None:
        table = table.withColumn("auc_weighted", F.lit(None).cast("double"))
    else:
        # One row per configuration.
        table = table.join(F.broadcast(auc), "config", "left")
    shown = [F.col(c) for c in ("accuracy", "f1_weighted", "f1_macro", "precision_weighted", "recall_weighted")]
    return table.withColumns({
        "auc_shown": F.coalesce("auc_weighted", F.lit(0.0)),
        "line": comparison_line(F.col("config"), shown, F.col("auc_weighted")),
    })


def auc_by_config(preds: DataFrame):
    """(config, auc_weighted) of all configurations at once; null where the truth has one class only."""
    configs = preds.select("config").distinct()
    return configs.join(weighted_auc(preds, by=["config"]), "config", "left")


def stage_coverage(preds: DataFrame):
    """Detection rate per kill-chain stage with the attacks it is made of."""
    classes = class_counts_from(confusion_counts(preds)).filter("class_id != 0 AND support > 0")
    attack = F.struct(
        F.col("class_id").alias("attack_id"), label_name(F.col("class_id")).alias("name"),
        F.col("support").alias("n_samples"), F.col("hits").alias("n_correct"),
        F.round(F.col("hits") / F.col("support"), 4).alias("detection_rate"),
    )
    stage = F.coalesce(F.try_element_at(literal_map(STAGES), F.col("class_id")), F.lit("Unknown"))
    return classes.groupBy(stage.alias("stage")).agg(
        F.sum("support").alias("total_samples"), F.sum("hits").alias("total_correct"),
        F.array_sort(F.collect_list(attack)).alias("attacks"),
    ).withColumn("stage_detection_rate", F.round(_ratio(F.col("total_correct"), F.col("total_samples")), 4))


def false_positive_profile(preds: DataFrame, columns=tuple(STAT_NAMES)):
    """Mean and population deviation of each statistic for benign rows called attack and called benign."""
    benign = preds.filter("y_true = 0").withColumn("is_fp", F.col("y_pred") != 0)
    aggs = []
    for c in columns:
        for kind, chosen in (("fp", F.col("is_fp")), ("tn", ~F.col("is_fp"))):
            value = F.when(chosen, F.col(c).cast("double"))
            aggs += [F.avg(value).alias(f"{kind}_mean_{c}"), F.stddev_pop(value).alias(f"{kind}_std_{c}")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[
            F.round(F.coalesce(F.col(f"{k}_{c}"), F.lit(0.0)), 4).alias(k)
            for k in ("fp_mean", "fp_std", "tn_mean", "tn_std")
        ]) for c in columns
    ]))
    return benign.agg(*aggs).select(rows.alias("r")).select("r.*")


def false_positive_totals(preds: DataFrame):
    """total_benign, true_negatives, false_positives, fp_rate."""
    call = F.col("y_pred") != 0
    return preds.filter("y_true = 0").agg(
        F.count("*").alias("total_benign"), F.count_if(~call).alias("true_negatives"),
        F.count_if(call).alias("false_positives"),
    ).withColumn("fp_rate", F.round(F.col("false_positives") / F.greatest("total_benign", F.lit(1)), 4))


def false_positive_classes(preds: DataFrame):
    """What benign rows called attack were taken for."""
    return preds.filter("y_true = 0 AND y_pred != 0").groupBy("y_pred").agg(F.count("*").alias("n")).select(
        label_name(F.col("y_pred")).alias("predicted_as"), "n"
    )


def calibration_edges(bins=10):
    return [i * (1 / bins) for i in range(bins)] + [1.0]


def calibration(preds: DataFrame, bins=10, digits=DIGITS):
    """Confidence bins [low, high): mean confidence, accuracy, rows. Confidence 1 is in no bin."""
    edges = calibration_edges(bins)
    rows = preds.select(
        F.round(confidence(F.col("probs"), F.col("y_pred")), digits).alias("conf"),
        (F.col("y_true") == F.col("y_pred")).cast("double").alias("ok"),
    )
    conf, which = F.col("conf"), F
    for i in range(bins):
        which = which.when((conf >= edges[i]) & (conf < edges[i + 1]), i)
    # Rows without a bin are dropped by their count after the aggregate: a filter on the bin would
    # be pushed below and repeat the whole score expression.
    return rows.withColumn("bin", which).groupBy("bin").agg(
        F.round(F.avg("conf"), 4).alias("mean_confidence"),
        F.round(F.avg("ok"), 4).alias("mean_accuracy"),
        F.count("bin").alias("n_samples"),
    ).filter("n_samples > 0").select(
        F.round(F.col("bin") / bins, 2).alias("bin_lower"), F.round((F.col("bin") + 1) / bins, 2).alias("bin_upper"),
        "mean_confidence", "mean_accuracy", "n_samples",
    )


def calibration_error(preds: DataFrame, bins=10, digits=DIGITS):
    """Expected calibration error over all rows, bins weighted by their share."""
    everything = preds.agg(F.count("*").alias("n_total")).withColumn("_one", F.lit(1))
    gaps = calibration(preds, bins, digits).agg(
        F.coalesce(F.sum(F.col("n_samples") * F.abs(F.col("mean_confidence") - F.col("mean_accuracy"))), F.lit(0.0)).alias("_gap")
    ).withColumn("_one", F.lit(1))
    return everything.join(F.broadcast(gaps), "_one").select(
        F.round(F.col("_gap") / F.col("n_total"), 4).alias("ece"), "n_total"
    )


def metrics_by(preds: DataFrame, column):
    """Accuracy and F1 per value of a column: latency curve (observed flows) or window ablation (size)."""
    return summary_metrics(preds, [column]).select(column, "accuracy", "f1_weighted", "f1_macro", "n_samples")


def best_exemplars(preds: DataFrame, item="session_id"):
    """Per class the correctly called row with the highest confidence; ties by lowest id."""
    conf = confidence(F.col("probs"), F.col("y_pred"))
    right = preds.filter(F.col("y_true") == F.col("y_pred")).withColumn("_c", conf)
    best = F.max_by(F.struct(F.col(item).alias(item), F.col("_c").alias("confidence")),
                    F.struct(F.col("_c"), -F.col(item)))
    return right.groupBy(F.col("y_true").alias("class_id")).agg(best.alias("b")).select(
        "class_id", label_name(F.col("class_id")).alias("attack_name"), "b.*"
    )


assert len(LABELS) == N_CLASSES
