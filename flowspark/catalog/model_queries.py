"""Queries that fit and apply models, and explain their results."""

from pyspark.sql import functions as F

from flowspark.catalog.adapters import ENRICHED_CTE, FLOW_COLUMNS, enriched, sessions_cte, table
from flowspark.catalog.sample_queries import split_cte
from flowspark.catalog.session_queries import KEYS, LABELLED_CTE, windows
from flowspark.functions.labels import label_name
from flowspark.functions.scores import confidence
from flowspark.functions.text import explanation_report
from flowspark.operators.explain import (
    event_weights, model_importance, occlusion, permutation_importance, top_events, weight_entropy,
)
from flowspark.operators.metrics import flow_evaluation, summary_metrics
from flowspark.operators.ordering import evenly
from flowspark.operators.sampling import stratified_split
from flowspark.operators.scaling import FeatureScaler
from flowspark.plans.analyze import analyze
from flowspark.plans.embedding import SessionEmbedder
from flowspark.plans.evaluate import score_configs
from flowspark.plans.models import ClassModel, DetectorSet, FlowClassifier, unseen_classes
from flowspark.plans.prepare import aligned_flows, session_table, split_sessions
from flowspark.schema import FEATURES, LOG_TYPE_NAMES, STAT_NAMES
from flowspark.session import materialise, work_dir
from flowspark.streaming.replay import score_stream, stream_parquet
from flowspark.streaming.sinks import start_table


def _session_rows(spark, sf_dir):
    """Sessions with split, statistics, label and embedding, prepared once and stored."""
    flows = materialise(split_sessions(enriched(spark, sf_dir)), "session-flows")
    scaler = FeatureScaler.fit(flows.filter("split = 'train'"), FLOW_COLUMNS)
    # one summary of the flows serves the fit and the embedding; a session is in one split
    summary = SessionEmbedder.summarise(flows, scaler, [*KEYS, "split"], [F.max("label_id").alias("_worst")])
    summed = materialise(session_table(flows, KEYS).join(summary, KEYS), "session-summary")
    embedder = SessionEmbedder.fit_summary(summed.filter("split = 'train' AND _worst = 0"), scaler, keys=KEYS)
    return materialise(embedder.embed(summed.drop("_worst")), "session-rows"), embedder


def split_by_session(spark, sf_dir):
    """Whole sessions per split and label."""
    flows = split_sessions(enriched(spark, sf_dir))
    return flows.groupBy("split").agg(
        F.count("*").alias("n_flows"), F.countDistinct(*KEYS).alias("n_sessions"),
        F.count_if(F.col("label_id") != 0).alias("n_attack_flows"),
    )


def split_flows_first(spark, sf_dir):
    """Flows split before windows are cut."""
    flows = split_sessions(enriched(spark, sf_dir), split_first=True)
    return flows.groupBy("split").agg(
        F.count("*").alias("n_flows"), F.countDistinct("session_idx").alias("n_sessions"),
        F.count_if(F.col("label_id") != 0).alias("n_attack_flows"),
    )


def session_embedding(spark, sf_dir):
    rows, _ = _session_rows(spark, sf_dir)
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("embedding")
    return rows.select(*KEYS, F.size(v).alias("dims"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 4).alias("energy"))


def models_abc(spark, sf_dir):
    """Three configurations trained on one split and measured on another."""
    rows, _ = _session_rows(spark, sf_dir)
    detectors = DetectorSet.fit(rows.filter("split = 'train'"))
    return summary_metrics(score_configs(detectors, rows.filter("split = 'test'")), ["config"])


def fallback(spark, sf_dir):
    """C scores a session unless a statistic is missing; then B does."""
    rows, _ = _session_rows(spark, sf_dir)
    detectors = DetectorSet.fit(rows.filter("split = 'train'"), configs=("B", "C"))
    broken = rows.withColumn("stat_syn_ratio", F.when(F.col("host") % 4 != 0, F.col("stat_syn_ratio")))
    scored = detectors.predict_with_fallback(broken)
    return scored.groupBy("config_used").agg(
        F.count("*").alias("n"), F.count_if(F.col("host") % 4 == 0).alias("n_broken"),
        F.count_if(F.col("probs").isNull()).alias("n_unscored"),
    )


def vector_classifier(spark, sf_dir):
    """A forest on the vectors of the embedding table, every class weighed alike."""
    from pyspark.ml.functions import array_to_vector
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", array_to_vector(F.col("embedding").cast("array<double>")))
    model = ClassModel.fit(rows, ["embedding"])
    return model.predict(rows).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("y_pred")).alias("n_right")
    )


def _flow_classifier(spark, sf_dir):
    """(the per-flow model, all flows with the 81 columns and their split)."""
    flows = enriched(spark, sf_dir).drop("session_idx")
    # the split numbers the rows of a class, which leaves most rows with the tasks of the largest class
    split = evenly(stratified_split(flows), flows.count(), ["flow_id", "host", "ts"])
    aligned = materialise(aligned_flows(split), "aligned-flows")
    train = aligned.filter("split <> 'test'").withColumn("validation", F.col("split") == "val")
    return FlowClassifier.fit(train), aligned


def flow_classifier(spark, sf_dir):
    """The report of the per-flow model on the test flows."""
    model, aligned = _flow_classifier(spark, sf_dir)
    scored = model.predict(aligned.filter("split = 'test'"))
    # the report passes over the scores several times
    return flow_evaluation(materialise(scored.select(F.col("label_id").alias("y_true"), "y_pred", "probs"), "scored-flows"))


def flow_classifier_stream(spark, sf_dir):
    """The same model on a stream of the flows: events written by the stream against those of the batch path."""
    model, aligned = _flow_classifier(spark, sf_dir)
    # a trigger takes a file for every core, as a batch has a task for a file
    stream = stream_parquet(spark, aligned.work_path, aligned.schema, spark.sparkContext.defaultParallelism)
    root = work_dir(spark, "scored")
    start_table(score_stream(stream, model=model), f"{root}/events", f"{root}/checkpoint").awaitTermination()
    streamed = spark.read.parquet(f"{root}/events").select("flow_id", "attack_id", "probabilities", "correct")
    batch = score_stream(aligned, model=model).select(
        "flow_id", F.col("attack_id").alias("b_id"), F.col("probabilities").alias("b_probs"), F.col("correct").alias("b_correct"))
    same = (F.col("attack_id") == F.col("b_id")) & (F.col("probabilities") == F.col("b_probs")) & F.col("correct").eqNullSafe(F.col("b_correct"))
    return streamed.join(batch, "flow_id", "full").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"),
        F.count_if(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p) - 1) < 1e-9).alias("n_sum_to_one"))


def new_classes(spark, sf_dir):
    """Ports of all flows that no attack flow used: classes a model of attacks would not know."""
    flows = enriched(spark, sf_dir).withColumn("label", F.col("destination_port"))
    return unseen_classes(flows.filter("label_id != 0"), flows)


def _session_number():
    """One number for host and session_idx: hosts below 2**31, sessions of a host below 2**32."""
    return F.shiftleft("host", 32) + F.col("session_idx")


def _fitted(spark, sf_dir):
    rows = materialise(session_table(windows(spark, sf_dir), KEYS).withColumn("sid", _session_number()), "sessions")
    return rows, ClassModel.fit(rows, list(STAT_NAMES))


def importance(spark, sf_dir):
    rows, model = _fitted(spark, sf_dir)
    return model_importance(spark, model.trees, model.feature_names(), 26)


def shuffled_importance(spark, sf_dir):
    """Accuracy lost when a statistic is shuffled among all sessions."""
    rows, model = _fitted(spark, sf_dir)
    return permutation_importance(model.score_index, rows, list(STAT_NAMES), "label", "sid")


def _means(rows):
    row = rows.agg(*[F.avg(c).alias(c) for c in STAT_NAMES]).first()
    return {c: row[c] for c in STAT_NAMES}


def occluded(spark, sf_dir):
    rows, model = _fitted(spark, sf_dir)
    return occlusion(model.score_index, rows, list(STAT_NAMES), _means(rows), "sid").select("sid", "feature", "rank", "importance")


def _weights(spark, sf_dir):
    flows = windows(spark, sf_dir)
    return event_weights(flows, FeatureScaler.fit(flows, FLOW_COLUMNS), KEYS)


def weights(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def heaviest(spark, sf_dir):
    return top_events(_weights(spark, sf_dir), 5, KEYS, 9).select(*KEYS, "pos", "rank", F.round("weight", 6).alias("weight"))


def entropies(spark, sf_dir):
    found = weight_entropy(_weights(spark, sf_dir), KEYS)
    return found.withColumn("attention_entropy", F.round("attention_entropy", 6))


def reports(spark, sf_dir):
    """Explanation text per session from its occlusion results and heaviest flows."""
    rows, model = _fitted(spark, sf_dir)
    parts = occlusion(model.score_index, rows, list(STAT_NAMES), _means(rows), "sid", 10)
    features = parts.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "importance", "value"))).alias("features"))
    events = top_events(_weights(spark, sf_dir), 5, KEYS).withColumn("sid", _session_number()).groupBy("sid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "pos", "weight"))).alias("events")
    )
    scored = model.predict(rows).join(features, "sid").join(events, "sid")
    text = explanation_report(
        label_name(F.col("y_pred")), confidence(F.col("probs"), F.col("y_pred")), F.col("features"), F.col("events")
    )
    return scored.select(*KEYS, text.alias("report"))


_SHOWN_STATS = ["syn_ratio", "port_entropy", "unique_dst_ports", "short_flow_ratio", "avg_win_size"]


def analyzed(spark, sf_dir):
    """Hosts as requests: their flows as arrays of 78 values, answered with alerts or rejected."""
    flows = enriched(spark, sf_dir)
    rows, embedder = _session_rows(spark, sf_dir)
    detectors = DetectorSet.fit(rows.filter("split = 'train'"), configs=("C",))
    have = set(flows.columns)
    values = F.array(*[F.col(c) if c in have else F.lit(0.0) for c in FEATURES])
    requests = flows.select(F.col("host").alias("request_id"), F.col("flow_id").alias("pos"), values.alias("features"), "log_type")
    embedder = SessionEmbedder(embedder.scaler, embedder.model, ["request_id"])
    alerts, rejected = analyze(requests, detectors, embedder, 1700000000.0, max_flows=70)
    entries = F.transform(F.map_entries("log_type_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    kept = alerts.select("request_id", "n_flows", "config_used", F.lit(True).alias("accepted"),
                         (F.col("threat_intelligence").isNull() == ~F.col("is_attack")).alias("intel_fits"),
                         F.array_join(F.array_sort(entries), ",").alias("log_types"),
                         *[F.col("session_stats")[f"stat_{s}"].alias(s) for s in _SHOWN_STATS])
    return kept.unionByName(rejected.select(
        "request_id", F.col("n_flows").cast("int").alias("n_flows"), F.lit(None).cast("string").alias("config_used"),
        F.lit(False).alias("accepted"), F.lit(True).alias("intel_fits"), F.lit(None).cast("string").alias("log_types"),
        *[F.lit(None).cast("double").alias(s) for s in _SHOWN_STATS],
    ))


_LOG_NAMES = "[" + ", ".join(f"'{n}'" for n in LOG_TYPE_NAMES.values()) + "]"


def _z_sql():
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FLOW_COLUMNS)
    total = " + ".join(f"pow(({c} - m_{c}) / s_{c}, 2)" for c in FLOW_COLUMNS)
    return f"""
WITH {ENRICHED_CTE}{sessions_cte()},
z AS (SELECT {stats} FROM session_flows),
d AS (SELECT host, session_idx, pos, {total} AS d FROM session_flows, z),
w AS (SELECT host, session_idx, pos, d / sum(d) OVER (PARTITION BY host, session_idx) AS weight FROM d)"""


QUERIES = {
    "split_by_session": (split_by_session, f"""
WITH {ENRICHED_CTE}{sessions_cte()}{LABELLED_CTE},
h AS (SELECT host, session_idx, label, CAST('0x' || substr(md5('session|' || host || '|' || session_idx), 1, 15) AS BIGINT) AS sid
      FROM labelled),
{split_cte('h', 'label', 'sid')},
f AS (SELECT * FROM session_flows JOIN split_h USING (host, session_idx))
SELECT split, count(*) AS n_flows, count(DISTINCT (host, session_idx)) AS n_sessions,
  count(*) FILTER (label_id <> 0) AS n_attack_flows FROM f GROUP BY 1"""),
    "split_flows_first": (split_flows_first, f"""
WITH {ENRICHED_CTE},
{split_cte('enriched', 'label_id', 'flow_id')},
o AS (SELECT split, label_id, row_number() OVER (PARTITION BY split
        ORDER BY CAST('0x' || substr(md5('42|' || flow_id), 1, 8) AS BIGINT), flow_id) - 1 AS i,
      count(*) OVER (PARTITION BY split) AS total FROM split_enriched)
SELECT split, count(*) AS n_flows, count(DISTINCT i // 20) AS n_sessions, count(*) FILTER (label_id <> 0) AS n_attack_flows
FROM o WHERE (i // 20) * 20 + 20 <= total GROUP BY 1"""),
    "session_embedding": (session_embedding, None),
    "models_abc": (models_abc, None),
    "fallback": (fallback, f"""
WITH {ENRICHED_CTE}{sessions_cte()},
s AS (SELECT DISTINCT host, session_idx FROM session_flows)
SELECT CASE WHEN host % 4 = 0 THEN 'B' ELSE 'C' END AS config_used, count(*) AS n,
  count(*) FILTER (host % 4 = 0) AS n_broken, CAST(0 AS BIGINT) AS n_unscored FROM s GROUP BY 1"""),
    "vector_classifier": (vector_classifier, None),
    "flow_classifier": (flow_classifier, None),
    "flow_classifier_stream": (flow_classifier_stream, """
SELECT count(*) AS n, count(*) AS n_same, count(*) AS n_sum_to_one FROM events"""),
    "unseen_classes": (new_classes, f"""
WITH {ENRICHED_CTE}
SELECT DISTINCT destination_port AS label FROM enriched
WHERE destination_port NOT IN (SELECT destination_port FROM enriched WHERE label_id <> 0)"""),
    "importance": (importance, None),
    "permutation_importance": (shuffled_importance, None),
    "occlusion": (occluded, None),
    "event_weights": (weights, f"{_z_sql()}\nSELECT host, session_idx, pos, round(weight, 6) AS weight FROM w"),
    "top_events": (heaviest, f"""{_z_sql()},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY host, session_idx ORDER BY round(weight, 9) DESC, pos) AS INT) AS rank FROM w)
SELECT host, session_idx, pos, rank, round(weight, 6) AS weight FROM r WHERE rank <= 5"""),
    "attention_entropy": (entropies, f"""{_z_sql()}
SELECT host, session_idx, round(-sum(weight * ln(weight + 1e-10)), 6) AS attention_entropy FROM w GROUP BY ALL"""),
    "explanation_report": (reports, None),
    "analyze_requests": (analyzed, f"""
WITH {ENRICHED_CTE},
l AS (SELECT host, string_agg(name || '=' || n, ',' ORDER BY name || '=' || n) AS log_types FROM
  (SELECT host, {_LOG_NAMES}[log_type + 1] AS name, count(*) AS n FROM enriched GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT host, count(*) AS n, round(sum(syn_flag_count) /
    sum(fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + urg_flag_count + 1e-9), 4) AS syn_ratio,
  round(entropy(CAST(destination_port AS BIGINT)), 4) AS port_entropy, CAST(count(DISTINCT destination_port) AS DOUBLE) AS unique_dst_ports,
  round(avg(CASE WHEN flow_duration < 100000 THEN 1e0 ELSE 0e0 END), 4) AS short_flow_ratio,
  round(avg((init_win_bytes_forward + init_win_bytes_backward) / 2e0), 4) AS avg_win_size FROM enriched GROUP BY host)
SELECT host AS request_id, CAST(n AS INT) AS n_flows, CASE WHEN n <= 70 THEN 'C' END AS config_used,
  n <= 70 AS accepted, true AS intel_fits, CASE WHEN n <= 70 THEN log_types END AS log_types,
  {", ".join(f"CASE WHEN n <= 70 THEN {s} END AS {s}" for s in _SHOWN_STATS)} FROM h JOIN l USING (host)"""),
}
