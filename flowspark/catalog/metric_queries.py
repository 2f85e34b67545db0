"""Queries over scored flows and sessions."""

from pyspark.sql import functions as F

from flowspark.catalog.adapters import (
    ENRICHED_CTE, PREDICTIONS_CTE, enriched, predictions, sessions_cte, values_cte,
)
from flowspark.catalog.session_queries import KEYS, LABELLED_CTE, windows
from flowspark.functions.labels import label_name
from flowspark.functions.scores import (
    argmax_class, confidence, decode_class, gated_class, gated_confidence, scatter_classes, softmax, top_predictions,
)
from flowspark.operators import metrics as M
from flowspark.plans.evaluate import latency_curve, window_ablation
from flowspark.plans.prepare import session_table
from flowspark.schema import LABELS, STAGES, THRESHOLDS

_NAMES = "[" + ", ".join(f"'{n}'" for n in LABELS.values()) + "]"

# Support, predicted and hits per class from prediction rows.
CLASSES_CTE = """,
classes AS (
  SELECT c.class_id, (SELECT count(*) FROM preds WHERE y_true = c.class_id) AS support,
    (SELECT count(*) FROM preds WHERE y_pred = c.class_id) AS predicted,
    (SELECT count(*) FROM preds WHERE y_true = c.class_id AND y_pred = c.class_id) AS hits
  FROM (SELECT CAST(i AS INT) AS class_id FROM range(15) r(i)) c
),
scored AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / CAST(predicted AS DOUBLE) ELSE 0e0 END AS prec,
    CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0e0 END AS rec,
    CASE WHEN support + predicted > 0 THEN 2 * hits / CAST(support + predicted AS DOUBLE) ELSE 0e0 END AS f1
  FROM classes
)"""

_SUMMARY = """round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
  round(avg(f1) FILTER (support + predicted > 0), 6) AS f1_macro,
  round(sum(prec * support) / sum(support), 6) AS precision_weighted,
  round(sum(rec * support) / sum(support), 6) AS recall_weighted,
  CAST(sum(support) AS BIGINT) AS n_samples,
  CAST(sum(support) FILTER (class_id <> 0) AS BIGINT) AS n_attacks,
  CAST(sum(support) FILTER (class_id = 0) AS BIGINT) AS n_benign"""


def _rounded(df, names, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


_SCORES = ["accuracy", "f1_weighted", "f1_macro", "precision_weighted", "recall_weighted"]


def confusion(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir))


def confusion_wide(spark, sf_dir):
    return M.confusion_pivot(predictions(spark, sf_dir))


def report(spark, sf_dir):
    return _rounded(M.class_report(predictions(spark, sf_dir)), ["precision", "recall", "f1"]).withColumnRenamed("class", "class_name")


def accuracy(spark, sf_dir):
    return _rounded(M.summary_metrics(predictions(spark, sf_dir)), _SCORES)


def rates(spark, sf_dir):
    return M.detection_rates(predictions(spark, sf_dir))


def binary(spark, sf_dir):
    return _rounded(M.binary_metrics(predictions(spark, sf_dir)), ["accuracy", "precision", "recall", "f1", "fpr"])


def sweep(spark, sf_dir):
    return M.threshold_sweep(predictions(spark, sf_dir))


def precision_area(spark, sf_dir):
    return _rounded(M.average_precision(predictions(spark, sf_dir)), ["average_precision"])


def class_auc(spark, sf_dir):
    return _rounded(M.one_vs_rest_auc(predictions(spark, sf_dir)), ["auc"])


def auc(spark, sf_dir):
    return _rounded(M.weighted_auc(predictions(spark, sf_dir)), ["auc_weighted"])


def full(spark, sf_dir):
    return _rounded(M.full_metrics(predictions(spark, sf_dir)), [*_SCORES, "auc_weighted"])


def flow_report(spark, sf_dir):
    return _rounded(M.flow_evaluation(predictions(spark, sf_dir)), [*_SCORES, "binary_accuracy", "binary_f1", "pr_auc"])


def stages(spark, sf_dir):
    found = M.stage_coverage(predictions(spark, sf_dir))
    parts = F.transform("attacks", lambda a: F.concat(a["name"], F.lit(":"), a["n_correct"].cast("string"),
                                                     F.lit("/"), a["n_samples"].cast("string")))
    return found.withColumn("attacks", F.array_join(parts, ","))


def session_calls(spark, sf_dir):
    """Sessions called by a simple rule on a statistic, with their statistics."""
    called = session_table(windows(spark, sf_dir), KEYS)
    y_pred = F.when(F.col("stat_short_flow_ratio") > 0.47, F.lit(4)).otherwise(0)
    return called.withColumns({"y_true": F.col("label"), "y_pred": y_pred})


_PROFILED = ["stat_avg_pkts_per_flow", "stat_port_entropy", "stat_syn_ratio", "stat_avg_win_size", "stat_unique_dst_ports"]


def fp_profile(spark, sf_dir):
    return M.false_positive_profile(session_calls(spark, sf_dir), _PROFILED)


def fp_totals(spark, sf_dir):
    return M.false_positive_totals(predictions(spark, sf_dir))


def fp_classes(spark, sf_dir):
    return M.false_positive_classes(predictions(spark, sf_dir))


def calibration(spark, sf_dir):
    return M.calibration(predictions(spark, sf_dir))


def calibration_error(spark, sf_dir):
    return M.calibration_error(predictions(spark, sf_dir))


def latency(spark, sf_dir):
    """How soon the label of the flows seen so far equals the label of the whole session."""
    curve = latency_curve(lambda t: t.withColumn("y_pred", F.col("observed_label")), windows(spark, sf_dir))
    return _rounded(curve, ["accuracy", "f1_weighted", "f1_macro"])


def ablation(spark, sf_dir):
    rule = F.when(F.col("stat_short_flow_ratio") > 0.47, F.lit(4)).otherwise(0)
    found = window_ablation(lambda t: t.withColumn("y_pred", rule), enriched(spark, sf_dir))
    return _rounded(found, ["accuracy", "f1_weighted", "f1_macro"])


def _configs(spark, sf_dir):
    """Three configurations of the same rows: as given, all benign, gated."""
    preds = predictions(spark, sf_dir)
    benign = preds.withColumn("y_pred", F.lit(0))
    gated = preds.withColumn("y_pred", gated_class(F.col("probs"), F.col("y_pred"), 0.75))
    parts = zip("ABC", (preds, benign, gated))
    first, *rest = [p.withColumn("config", F.lit(f"Config {c}")) for c, p in parts]
    for r in rest:
        first = first.unionByName(r)
    return first


def configs(spark, sf_dir):
    preds = _configs(spark, sf_dir)
    found = M.compare_configs(preds, M.auc_by_config(preds))
    return _rounded(found, [*_SCORES, "auc_weighted", "auc_shown"])


def exemplar(spark, sf_dir):
    return _rounded(M.best_exemplars(predictions(spark, sf_dir)), ["confidence"])


def scatter(spark, sf_dir):
    """Four trained classes spread over 15 slots and back."""
    classes = [0, 2, 4, 10]
    preds = predictions(spark, sf_dir)
    four = F.array(*[F.get("probs", F.lit(c)) for c in classes])
    spread = scatter_classes(four, classes)
    index = (argmax_class(four)).alias("i")
    return preds.select(
        "session_id", F.array_join(F.transform(spread, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",").alias("spread"),
        decode_class(index, classes).alias("decoded"),
    )


def best_three(spark, sf_dir):
    preds = predictions(spark, sf_dir).select("session_id", F.posexplode(top_predictions(F.col("probs"), 3)).alias("rank", "p"))
    return preds.select("session_id", F.col("rank").cast("bigint").alias("rank"), "p.*")


def softmaxes(spark, sf_dir):
    """Softmax of ten times the probabilities, with its first maximum."""
    soft = softmax(F.transform("probs", lambda p: p * 10))
    rows = predictions(spark, sf_dir).select("session_id", soft.alias("s"))
    return rows.select(
        "session_id", argmax_class(F.col("s")).alias("called"), F.round(F.array_max("s"), 6).alias("top"),
        F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def gate(spark, sf_dir):
    p, c = F.col("probs"), F.col("y_pred")
    return predictions(spark, sf_dir).select(
        "session_id", gated_class(p, c, 0.75).alias("gated_id"), F.round(gated_confidence(p, c, 0.75), 6).alias("confidence"),
        F.round(confidence(p, c + 12), 6).alias("shifted_confidence"), label_name(gated_class(p, c, 0.75)).alias("gated_name"),
    )


_P = f"WITH {PREDICTIONS_CTE}"
_PC = f"{_P}{CLASSES_CTE}"


def _edges_case(value):
    edges = M.calibration_edges()
    whens = " ".join(
        f"WHEN {value} >= {edges[i]:.17e} AND {value} < {edges[i + 1]:.17e} THEN {i}" for i in range(10)
    )
    return f"CASE {whens} END"


_CALIBRATION = f"""{_P},
c AS (SELECT round(probs[y_pred + 1], 9) AS conf, CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END AS ok FROM preds),
b AS (SELECT *, {_edges_case('conf')} AS bin FROM c),
bins AS (SELECT round(bin / 10e0, 2) AS bin_lower, round((bin + 1) / 10e0, 2) AS bin_upper,
  round(avg(conf), 4) AS mean_confidence, round(avg(ok), 4) AS mean_accuracy, count(*) AS n_samples
  FROM b WHERE bin IS NOT NULL GROUP BY bin)"""

# Area under the ROC curve of class c by counting pairs, ties as one half.
_AUC_CTE = """,
present AS (SELECT list(DISTINCT y_true) AS ids FROM preds),
pairs AS (
  SELECT CAST(c AS INT) AS class_id, y_true = c AS positive,
    round(probs[c + 1] / greatest(list_sum(list_transform(ids, lambda i: probs[i + 1])), 1e-10), 9) AS score
  FROM preds, present, (SELECT unnest(ids) AS c FROM present) u
),
grouped AS (
  SELECT class_id, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg
  FROM pairs GROUP BY ALL
),
ranked AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY class_id ORDER BY score
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM grouped
),
aucs AS (
  SELECT class_id, CAST(sum(pos) AS BIGINT) AS support,
    sum(pos * (below + neg / 2e0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS auc
  FROM ranked GROUP BY 1
)"""

_AP_CTE = """,
curve AS (
  SELECT round(1 - probs[1], 9) AS score, count(*) FILTER (y_true <> 0) AS pos, count(*) AS n FROM preds GROUP BY 1
),
cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS calls, sum(pos) OVER () AS total FROM curve
  WINDOW w AS (ORDER BY score DESC)
),
ap AS (SELECT sum(pos / CAST(total AS DOUBLE) * tp / calls) AS average_precision FROM cum)"""


def _threshold_sql():
    return f"""{_P},
s AS (SELECT round(1 - probs[1], 9) AS score, y_true <> 0 AS truth FROM preds),
t AS (SELECT threshold, count(*) FILTER (truth AND score >= threshold) AS tp,
  count(*) FILTER (NOT truth AND score >= threshold) AS fp, count(*) FILTER (truth AND score < threshold) AS fn,
  count(*) FILTER (NOT truth AND score < threshold) AS tn
  FROM s, (SELECT unnest([{', '.join(f'{t}e0' for t in THRESHOLDS)}]) AS threshold) GROUP BY 1),
r AS (SELECT *, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS tpr0, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS prec0 FROM t)
SELECT threshold, round(tpr0, 4) AS tpr, round(fp / CAST(greatest(fp + tn, 1) AS DOUBLE), 4) AS fpr,
  round(prec0, 4) AS precision, round(tpr0, 4) AS recall,
  round(2 * prec0 * tpr0 / greatest(prec0 + tpr0, 1e-9), 4) AS f1, tp, fp, fn, tn FROM r"""


def _config_sql():
    return f"""{_P},
configs AS (
  SELECT 'Config A' AS config, y_true, y_pred, probs FROM preds
  UNION ALL SELECT 'Config B', y_true, 0, probs FROM preds
  UNION ALL SELECT 'Config C', y_true, CASE WHEN 1 - probs[1] < 0.75e0 THEN 0 ELSE y_pred END, probs FROM preds
),
ids AS (SELECT config, CAST(i AS INT) AS class_id FROM (SELECT DISTINCT config FROM configs), range(15) r(i)),
sup AS (SELECT config, y_true AS class_id, count(*) AS support, count(*) FILTER (y_true = y_pred) AS hits FROM configs GROUP BY ALL),
pre AS (SELECT config, y_pred AS class_id, count(*) AS predicted FROM configs GROUP BY ALL),
classes AS (SELECT config, class_id, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
  FROM ids LEFT JOIN sup USING (config, class_id) LEFT JOIN pre USING (config, class_id)),
scored AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / CAST(predicted AS DOUBLE) ELSE 0e0 END AS prec,
    CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0e0 END AS rec,
    CASE WHEN support + predicted > 0 THEN 2 * hits / CAST(support + predicted AS DOUBLE) ELSE 0e0 END AS f1
  FROM classes
),
summary AS (SELECT config, {_SUMMARY} FROM scored GROUP BY config)
{_AUC_CTE},
w AS (SELECT round(sum(auc * support) / sum(support), 6) AS a FROM aucs)
SELECT s.*, a AS auc_weighted, a AS auc_shown,
  rpad(config, 30, ' ') || ' ' || lpad(printf('%.4f', accuracy), 10, ' ') || ' ' || lpad(printf('%.4f', f1_weighted), 8, ' ')
  || ' ' || lpad(printf('%.4f', f1_macro), 8, ' ') || ' ' || lpad(printf('%.4f', precision_weighted), 10, ' ')
  || ' ' || lpad(printf('%.4f', recall_weighted), 8, ' ') || ' '
  || lpad(printf('%.4f', a), 8, ' ') AS line
FROM summary s, w"""


def _grouped_summary_sql(source, by):
    """Accuracy and F1 by a column of (by, y_true, y_pred) rows."""
    return f"""
sup AS (SELECT {by}, y_true AS class_id, count(*) AS support, count(*) FILTER (y_true = y_pred) AS hits FROM {source} GROUP BY ALL),
pre AS (SELECT {by}, y_pred AS class_id, count(*) AS predicted FROM {source} GROUP BY ALL),
cls AS (SELECT {by}, class_id, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
  FROM sup FULL JOIN pre USING ({by}, class_id)),
f AS (SELECT *, 2 * hits / CAST(support + predicted AS DOUBLE) AS f1 FROM cls)
SELECT CAST({by} AS INT) AS {by}, round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro,
  CAST(sum(support) AS BIGINT) AS n_samples FROM f GROUP BY {by}"""


def _label_of(source, extra=""):
    """Session label by (host, session_idx[, extra]) over rows of a source."""
    keys = f"host, session_idx{extra}"
    return f"""SELECT {keys}, CAST(coalesce(arg_max(CASE WHEN label_id <> 0 THEN label_id END,
    CASE WHEN label_id <> 0 THEN rows_of * 100 - label_id END), 0) AS INT) AS label
  FROM (SELECT {keys}, label_id, count(*) AS rows_of FROM {source} GROUP BY ALL) GROUP BY ALL"""


_LATENCY_SQL = f"""
WITH {ENRICHED_CTE}{sessions_cte()},
whole AS ({_label_of('session_flows')}),
cut AS (SELECT s.*, n_flows FROM session_flows s, (VALUES (3), (5), (8), (10), (15), (20)) v(n_flows) WHERE pos < n_flows),
seen AS ({_label_of('cut', ', n_flows')}),
rows AS (SELECT n_flows, w.label AS y_true, s.label AS y_pred FROM seen s JOIN whole w USING (host, session_idx)),
{_grouped_summary_sql('rows', 'n_flows')}"""


def _ablation_sql():
    ctes, parts = "", []
    for size in (10, 20, 50):
        ctes += sessions_cte(size, size, name=f"w{size}")
        ctes += f""",
l{size} AS ({_label_of(f'w{size}')}),
r{size} AS (SELECT {size} AS size, label AS y_true,
  CASE WHEN avg(CASE WHEN flow_duration < 100000 THEN 1e0 ELSE 0e0 END) > 0.47e0 THEN 4 ELSE 0 END AS y_pred
  FROM w{size} JOIN l{size} USING (host, session_idx) GROUP BY host, session_idx, label)"""
        parts.append(f"SELECT size, y_true, y_pred FROM r{size}")
    return f"WITH {ENRICHED_CTE}{ctes},\nrows AS ({' UNION ALL '.join(parts)}),{_grouped_summary_sql('rows', 'size')}"


def _profile_sql():
    exprs = {
        "stat_avg_pkts_per_flow": "avg(total_fwd_packets + total_backward_packets)",
        "stat_port_entropy": "entropy(CAST(destination_port AS BIGINT))",
        "stat_syn_ratio": "sum(syn_flag_count) / sum(fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + urg_flag_count + 1e-9)",
        "stat_avg_win_size": "avg((init_win_bytes_forward + init_win_bytes_backward) / 2e0)",
        "stat_unique_dst_ports": "CAST(count(DISTINCT destination_port) AS DOUBLE)",
    }
    cells = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    rows = " UNION ALL ".join(f"""SELECT '{n}' AS feature,
  round(coalesce(avg({n}) FILTER (is_fp), 0), 4) AS fp_mean, round(coalesce(stddev_pop({n}) FILTER (is_fp), 0), 4) AS fp_std,
  round(coalesce(avg({n}) FILTER (NOT is_fp), 0), 4) AS tn_mean, round(coalesce(stddev_pop({n}) FILTER (NOT is_fp), 0), 4) AS tn_std
FROM b""" for n in exprs)
    return f"""
WITH {ENRICHED_CTE}{sessions_cte()}{LABELLED_CTE},
s AS (SELECT host, session_idx, avg(CASE WHEN flow_duration < 100000 THEN 1e0 ELSE 0e0 END) > 0.47e0 AS is_fp, {cells}
      FROM session_flows GROUP BY ALL),
b AS (SELECT s.* FROM s JOIN labelled USING (host, session_idx) WHERE label = 0)
{rows}"""


def _stage_sql():
    dim = values_cte("dim", ["class_id", "stage", "name"], [(i, STAGES[i], LABELS[i]) for i in LABELS])
    return f"""{_PC},
{dim}
SELECT stage, CAST(sum(support) AS BIGINT) AS total_samples, CAST(sum(hits) AS BIGINT) AS total_correct,
  string_agg(name || ':' || hits || '/' || support, ',' ORDER BY class_id) AS attacks,
  round(sum(hits) / CAST(sum(support) AS DOUBLE), 4) AS stage_detection_rate
FROM classes JOIN dim USING (class_id) WHERE class_id <> 0 AND support > 0 GROUP BY stage"""


_BINARY = """count(*) FILTER (y_true <> 0 AND y_pred <> 0) AS tp, count(*) FILTER (y_true = 0 AND y_pred <> 0) AS fp,
  count(*) FILTER (y_true <> 0 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn"""

QUERIES = {
    "confusion": (confusion, f"""{_P}
SELECT CAST(t.i AS INT) AS y_true, CAST(p.i AS INT) AS y_pred, count(q.session_id) AS n
FROM range(15) t(i) CROSS JOIN range(15) p(i) LEFT JOIN preds q ON q.y_true = t.i AND q.y_pred = p.i GROUP BY 1, 2"""),
    "confusion_pivot": (confusion_wide, f"""{_P}
SELECT CAST(t.i AS INT) AS y_true, {', '.join(f'count(*) FILTER (y_pred = {c}) AS p{c}' for c in range(15))}
FROM range(15) t(i) LEFT JOIN preds q ON q.y_true = t.i GROUP BY 1"""),
    "class_report": (report, f"""{_PC}
SELECT {_NAMES}[class_id + 1] AS class_name, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1,
  support FROM scored
UNION ALL SELECT 'accuracy', round(sum(hits) / CAST(sum(support) AS DOUBLE), 6), round(sum(hits) / CAST(sum(support) AS DOUBLE), 6),
  round(sum(hits) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM scored
UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM scored
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scored"""),
    "accuracy_f1": (accuracy, f"{_PC}\nSELECT {_SUMMARY} FROM scored"),
    "detection_rate": (rates, f"""{_PC}
SELECT class_id, {_NAMES}[class_id + 1] AS attack_name, support AS true_count, hits AS detected_count,
  round(hits / CAST(support AS DOUBLE), 4) AS detection_rate, predicted - hits AS false_positives,
  round((predicted - hits) / CAST(greatest((SELECT count(*) FROM preds) - support, 1) AS DOUBLE), 6) AS fp_rate
FROM classes WHERE class_id <> 0 AND support > 0"""),
    "binary_metrics": (binary, f"""{_P},
b AS (SELECT {_BINARY} FROM preds)
SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy,
  round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
  round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(fp / CAST(fp + tn AS DOUBLE), 6) AS fpr FROM b"""),
    "threshold_sweep": (sweep, _threshold_sql()),
    "average_precision": (precision_area, f"{_P}{_AP_CTE}\nSELECT round(average_precision, 6) AS average_precision FROM ap"),
    "ovr_auc": (class_auc, f"{_P}{_AUC_CTE}\nSELECT class_id, support, round(auc, 6) AS auc FROM aucs"),
    "weighted_auc": (auc, f"{_P}{_AUC_CTE}\nSELECT round(sum(auc * support) / sum(support), 6) AS auc_weighted FROM aucs"),
    "full_metrics": (full, f"""{_PC}{_AUC_CTE},
s AS (SELECT {_SUMMARY} FROM scored), w AS (SELECT round(sum(auc * support) / sum(support), 6) AS auc_weighted FROM aucs)
SELECT s.*, w.auc_weighted FROM s, w"""),
    "flow_evaluation": (flow_report, f"""{_PC}{_AP_CTE},
s AS (SELECT {_SUMMARY} FROM scored), b AS (SELECT {_BINARY} FROM preds)
SELECT s.*, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS binary_accuracy,
  round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS binary_f1, round(average_precision, 6) AS pr_auc FROM s, b, ap"""),
    "stage_coverage": (stages, _stage_sql()),
    "fp_profile": (fp_profile, _profile_sql()),
    "fp_totals": (fp_totals, f"""{_P}
SELECT count(*) AS total_benign, count(*) FILTER (y_pred = 0) AS true_negatives, count(*) FILTER (y_pred <> 0) AS false_positives,
  round(count(*) FILTER (y_pred <> 0) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS fp_rate FROM preds WHERE y_true = 0"""),
    "fp_classes": (fp_classes, f"""{_P}
SELECT {_NAMES}[y_pred + 1] AS predicted_as, count(*) AS n FROM preds WHERE y_true = 0 AND y_pred <> 0 GROUP BY 1"""),
    "calibration": (calibration, f"{_CALIBRATION}\nSELECT * FROM bins"),
    "calibration_error": (calibration_error, f"""{_CALIBRATION}
SELECT round(sum(n_samples * abs(mean_confidence - mean_accuracy)) / (SELECT count(*) FROM preds), 4) AS ece,
  (SELECT count(*) FROM preds) AS n_total FROM bins"""),
    "latency_curve": (latency, _LATENCY_SQL),
    "window_ablation": (ablation, _ablation_sql()),
    "compare_configs": (configs, _config_sql()),
    "exemplar_best": (exemplar, f"""{_P}
SELECT y_true AS class_id, {_NAMES}[y_true + 1] AS attack_name, session_id, round(probs[y_pred + 1], 6) AS confidence FROM preds
WHERE y_true = y_pred
QUALIFY row_number() OVER (PARTITION BY y_true ORDER BY probs[y_pred + 1] DESC, session_id) = 1"""),
    "proba_scatter": (scatter, f"""{_P}
SELECT session_id, array_to_string(list_transform(range(15), lambda c: CASE WHEN c IN (0, 2, 4, 10)
    THEN CAST(CAST(round(probs[c + 1] * 1e6) AS BIGINT) AS VARCHAR) ELSE '0' END), ',') AS spread,
  CASE list_max([probs[1], probs[3], probs[5], probs[11]]) WHEN probs[1] THEN 0 WHEN probs[3] THEN 2 WHEN probs[5] THEN 4
    ELSE 10 END AS decoded FROM preds"""),
    "top_predictions": (best_three, f"""{_P},
e AS (SELECT session_id, unnest(probs) AS p, unnest(range(15)) AS c FROM preds),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY p DESC, c) - 1 AS rank FROM e)
SELECT session_id, rank, CAST(c AS INT) AS attack_id, {_NAMES}[c + 1] AS attack_name, round(p, 4) AS probability
FROM r WHERE rank < 3"""),
    "softmax": (softmaxes, f"""{_P},
e AS (SELECT session_id, list_transform(probs, lambda p: exp(p * 10 - list_max(probs) * 10)) AS x FROM preds)
SELECT session_id, CAST(list_position(x, list_max(x)) - 1 AS INT) AS called, round(list_max(x) / list_sum(x), 6) AS top,
  1e0 AS total FROM e"""),
    "attack_gate": (gate, f"""{_P},
g AS (SELECT *, 1 - probs[1] < 0.75e0 AS low FROM preds)
SELECT session_id, CAST(CASE WHEN low THEN 0 ELSE y_pred END AS INT) AS gated_id,
  round(CASE WHEN low THEN probs[1] ELSE probs[y_pred + 1] END, 6) AS confidence,
  round(CASE WHEN y_pred + 12 < 15 THEN probs[y_pred + 13] ELSE 0e0 END, 6) AS shifted_confidence,
  {_NAMES}[CASE WHEN low THEN 0 ELSE y_pred END + 1] AS gated_name FROM g"""),
}
