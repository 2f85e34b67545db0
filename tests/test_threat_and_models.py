import math
import re
from collections import Counter
from multiprocessing.pool import ThreadPool

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.catalog.model_queries import flow_classifier
from flowspark.errors import EnrichmentError, FeatureDimensionError, InferenceError, ModelNotLoadedError
from flowspark.functions.alerts import intel_from_kb
from flowspark.functions.alignment import realign_array
from flowspark.functions.cleaning import clean_sql
from flowspark.functions.text import kb_text, retrieval_query
from flowspark.knowledge import CATEGORY, TACTICS, TECHNIQUE_NAMES, TECHNIQUES, TRUTH, entries, knowledge_base
from flowspark.operators import explain as E
from flowspark.operators import nearest_join as nearest_join_module
from flowspark.operators import neighbors as N
from flowspark.operators.nearest_join import nearest_join
from flowspark.operators.ordering import evenly
from flowspark.operators.text_index import TextIndex
from flowspark.operators import threat as T
from flowspark.operators.scaling import FeatureScaler
from flowspark.operators.stats import session_stats, stat_inputs
from flowspark.plans.analyze import aligned_requests
from flowspark.plans.embedding import SessionEmbedder, TextEmbedder
from flowspark.plans.enrich import KnowledgeSearch, enrich_alerts
from flowspark.plans.models import BOOSTING, COPY_BYTES, ClassModel, DetectorSet, FlowClassifier, unseen_classes
from flowspark.plans.prepare import split_sessions
from flowspark.schema import LABELS, STAT_NAMES, TRAINED_FEATURES
from flowspark.session import free_memory, materialise


def vectors(spark, n, name, seed):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 6)).round(1)
    data[3] = 0.0
    data[5] = data[4]
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>, kind int").repartition(5), data


def brute_nearest(a, b, k, allowed=None):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    d = np.round(1 - unit(a) @ unit(b).T, 9)
    ids = [j for j in range(len(b)) if allowed is None or allowed(j)]
    return [sorted(ids, key=lambda j: (row[j], j))[:k] for row in d]


@pytest.mark.parametrize("k", [1, 4, 99])
def test_nearest_of_a_small_index(spark, k):
    queries, q = vectors(spark, 40, "qid", 1)
    index, x = vectors(spark, 12, "id", 2)
    got = {r.qid: [h.id for h in r.hits] for r in N.nearest(queries, index, k).collect()}
    want = brute_nearest(q, x, min(k, 12))
    assert [got[i] for i in range(40)] == want
    rows = N.hit_rows(N.nearest(queries, index, k), ["qid"]).collect()
    assert {(r.qid, r["rank"], r.id) for r in rows} == {(q, i, j) for q, hits in got.items() for i, j in enumerate(hits)}
    some = N.nearest(queries, index, 2, where=F.col("kind") == 1).collect()
    want = brute_nearest(q, x, 2, lambda j: j % 3 == 1)
    assert {r.qid: [h.id for h in r.hits] for r in some} == dict(enumerate(want))


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_in_a_large_index(spark, k):
    index, x = vectors(spark, 300, "id", 3)
    queries, q = vectors(spark, 9, "query_id", 4)
    found = N.nearest_in_large(index, queries, k, "id").collect()
    got = [[r.id for r in sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)] for i in range(9)]
    assert got == brute_nearest(q, x, k)


def test_two_sides_above_the_limit_are_joined_in_blocks(spark, monkeypatch):
    index, x = vectors(spark, 30, "id", 3)
    queries, q = vectors(spark, 20, "qid", 4)
    monkeypatch.setattr(N, "MAX_SMALL_ROWS", 10)
    want = brute_nearest(q, x, 2)
    got = {r.qid: [h.id for h in r.hits] for r in N.nearest(queries, index, 2).collect()}
    assert [got[i] for i in range(20)] == want
    found = N.nearest_in_large(index, queries.withColumnRenamed("qid", "query_id"), 2, "id").collect()
    assert [[r.id for r in sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)] for i in range(20)] == want


@pytest.mark.parametrize("k, block_rows", [(1, 16), (5, 16), (7, 4096)])
def test_blocked_join_against_all_pairs(spark, k, block_rows):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 5))
    data = np.concatenate([c + rng.normal(scale=0.05, size=(40, 5)) for c in centres]).round(2)
    data[7] = 0.0
    data[20:90] = data[20]          # a large group of copies
    data[100] = [1e200, 1e200, 0, 0, 0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(999, None)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    found = nearest_join(table, table, k, "id", block_rows=block_rows, pivots=8).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    scaled = data / np.maximum(np.abs(data).max(axis=1, keepdims=True), 1e-300)
    assert [got[i] for i in range(len(data))] == brute_nearest(scaled, scaled, k) and 999 not in got
    assert nearest_join(table, table.limit(0), k, "id").count() == 0


@pytest.mark.parametrize("k, tile", [(1, 8192), (5, 8192), (5, 16)])
def test_rows_of_a_block_beyond_the_limits_are_left_out(monkeypatch, k, tile):
    monkeypatch.setattr(nearest_join_module, "TILE_ROWS", tile)
    monkeypatch.setattr(nearest_join_module, "TILE_PAIRS", 7)
    rng = np.random.default_rng(4)
    rows = nearest_join_module.unit(rng.normal(size=(300, 6)).round(1))
    rows[10:30] = rows[10]
    rows[50:55] = 0.0
    asking = np.concatenate([rows[:40], rows[50:51] * 1.0, -rows[:1]])
    far = np.round(1.0 - asking @ rows.T, 9)
    limits = np.where(np.arange(len(asking)) % 2 == 0, 0.05, 2.0)
    row, at, distance = nearest_join_module._nearest_rows(asking, rows, limits, k)
    best = np.argsort(far, axis=1, kind="stable")[:, :k]
    want = [(i, j) for i in range(len(asking)) for j in best[i] if far[i, j] <= limits[i]]
    assert list(zip(row, at)) == want
    assert (distance == far[row, at]).all()
    assert [len(x) for x in nearest_join_module._nearest_rows(asking[:0], rows, limits[:0], k)] == [0, 0, 0]


def test_missing_vectors(spark):
    queries, _ = vectors(spark, 8, "qid", 1)
    holed = queries.withColumn("embedding", F.when(F.col("qid") != 2, F.col("embedding")))
    found = {r.qid: len(r.hits) for r in N.nearest(holed, holed.withColumnRenamed("qid", "id"), 3).collect()}
    assert found[2] == 0 and found[0] == 3
    large = N.nearest_in_large(holed.withColumnRenamed("qid", "id"), queries.withColumnRenamed("qid", "query_id"), 8, "id")
    assert large.filter("id = 2").count() == 0 and large.filter("query_id = 2").count() == 7


def test_empty_index_gives_no_hits(spark):
    queries, _ = vectors(spark, 8, "qid", 1)
    assert all(r.hits == [] for r in N.nearest(queries, queries.withColumnRenamed("qid", "id"), 3, where="kind = 9").collect())


def test_knowledge_base_is_complete():
    rows = entries()
    assert [r["attack_id"] for r in rows] == list(LABELS) == list(CATEGORY) == list(TRUTH) == list(TACTICS)
    assert {c for codes in TECHNIQUES.values() for c in codes} == set(TECHNIQUE_NAMES)
    assert all(r["description"] and r["tags"] and r["response_actions"] for r in rows)


def test_unknown_class_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 2), (2, 77), (3, 0)], "session_id long, attack_id int")
    rows = {r.session_id: r for r in T.join_knowledge_base(df).collect()}
    assert rows[1].severity == "CRITICAL" and rows[2].severity == "UNKNOWN" and rows[2].techniques == []
    assert rows[2].attack_name == "Unknown (77)" and len(rows) == 3
    intel = {r.session_id: r.threat_intelligence for r in T.add_threat_intel(df.withColumn("attack_name", F.lit("x"))).collect()}
    assert intel[3] is None and len(intel[1].techniques) <= 3 and intel[2].severity == "UNKNOWN"


def test_search_and_lookup(spark):
    search = KnowledgeSearch.build(spark)
    names = spark.createDataFrame([(n,) for i, n in LABELS.items() if i], "query string")
    found = {r["query"]: r for r in search.lookup(names).collect()}
    score = T.precision_at_1(search.lookup(names)).first()
    assert score.total == 14 and score.correct == sum(q == r.top_result for q, r in found.items())
    assert score.precision_at_1 >= 0.9 and all(len(r.similar_threats) == 3 for r in found.values())
    only = search.search(names, severity="CRITICAL", k=50).first()
    assert sorted(h.id for h in only.hits) == [2, 8, 9, 13]


def test_text_index_against_plain_cosines(spark):
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(30)] + ["Common", "É.1"]
    texts = [(i, " ".join(["common", *rng.choice(pool, 12)])) for i in range(12)] + [(20, "only here")]
    asked = [(i, " ".join(rng.choice(pool + ["unknown"], rng.integers(1, 40)))) for i in range(30)]
    asked += [(90, None), (91, ""), (92, "common"), (93, "unknown words"), (94, asked[0][1]), (94, asked[0][1])]

    def counts(text):
        return Counter(w for w in re.split(r"[^\w.]+", (text or "").lower()) if w)

    n = len(texts)
    frequency = Counter(w for _, t in texts for w in counts(t))

    def weights(text):
        raw = {w: c * math.log((n + 1) / (frequency.get(w, 0) + 1)) for w, c in counts(text).items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / length for w, x in raw.items()} if length else {}

    index = TextIndex.fit(spark.createDataFrame(texts, "id long, text string"), keep=5)
    queries = spark.createDataFrame([(i, t, "x") for i, t in asked], "qid long, text string, id string")
    got = sorted((r.qid, [(h.id, round(h.distance, 7)) for h in r.hits]) for r in index.search(queries, "text", 4).collect())
    want = []
    for i, text in asked:
        w = weights(text)
        far = sorted((round(1 - sum(x * weights(t).get(k, 0.0) for k, x in w.items()), 9), j) for j, t in texts)
        want.append((i, [(j, round(d, 7)) for d, j in far[:4]]))
    assert got == sorted(want)
    with pytest.raises(ValueError):
        index.search(queries, "text", 6)


def test_lookup_rule(spark):
    rows = [("dos", [2, 4, 3]), ("nothing", [7, 1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "query string, ids array<int>").withColumn(
        "hits", F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(0.0).alias("distance"))))
    got = {r["query"]: r for r in T.lookup_entry(df).collect()}
    assert got["dos"].attack_id == 2 and got["nothing"].attack_id == 7
    assert got["nothing"].similar_threats == [LABELS[1], LABELS[2], LABELS[3]]


def test_enrichment_searches_each_sentence_once(spark):
    search = KnowledgeSearch.build(spark)
    stats = {c: 0.0 for c in STAT_NAMES}
    rows = [(i, 4, [0.1] * 15, *{**stats, "stat_syn_ratio": 0.9 if i % 2 else 0.1}.values()) for i in range(20)]
    df = spark.createDataFrame(rows, "sid int, attack_id int, probs array<double>, " + ", ".join(f"{c} double" for c in STAT_NAMES))
    found = enrich_alerts(df, search).collect()
    assert len(found) == 20 and all(len(r.rag_context) == 2 and len(r.retrieved) == 3 for r in found)
    assert all(len(c) <= 400 for r in found for c in r.rag_context)
    texts = {r.query_text for r in found}
    assert texts == {"Detected attack type: DoS Hulk",
                     "Detected attack type: DoS Hulk. High SYN flag ratio suggesting SYN flood"}
    plain = spark.createDataFrame([(4,)], "x int").select(
        retrieval_query(F.lit("a"), lambda name: F.lit(1e9 if name == "stat_avg_flow_bps" else 0.0)))
    assert plain.first()[0] == "Detected attack type: a. High bandwidth suggesting volumetric attack"


def test_kb_text_lines(spark):
    text = knowledge_base(spark).filter("attack_id = 10").select(kb_text()).first()[0].split("\n")
    assert text[0] == "ATTACK: PortScan" and text[5].startswith("MITRE TECHNIQUES: T1046 - ") and len(text) == 10
    assert intel_from_kb() is not None


@pytest.fixture(scope="module")
def sessions(spark):
    """Separable sessions of three classes with statistics and an embedding."""
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        c = [0, 4, 10][i % 3]
        stats = [float(x) for x in rng.normal(c, 0.3, len(STAT_NAMES))]
        rows.append((i, c, [float(x) for x in rng.normal(-c, 0.3, 4)], *stats))
    schema = "sid long, label int, e array<double>, " + ", ".join(f"{s} double" for s in STAT_NAMES)
    return spark.createDataFrame(rows, schema).withColumn("embedding", array_to_vector("e")).drop("e").cache()


@pytest.fixture(scope="module")
def detectors(sessions):
    return DetectorSet.fit(sessions, numTrees=5, maxDepth=4)


def test_three_configurations(sessions, detectors):
    for c in "ABC":
        scored = detectors.predict(sessions, c)
        assert scored.filter("y_pred = label").count() >= 297 and scored.first().config == c
        row = scored.first()
        assert len(row.probs) == 15 and sum(row.probs) == pytest.approx(1) and row.probs[1] == 0.0


def test_fallback_order(sessions, detectors):
    assert detectors.predict_with_fallback(sessions).select("config_used").distinct().first()[0] == "C"
    broken = sessions.withColumn("stat_syn_ratio", F.when(F.col("sid") % 2 == 0, F.col("stat_syn_ratio")))
    used = {(r.sid % 2, r.config_used) for r in detectors.predict_with_fallback(broken).collect()}
    assert used == {(0, "C"), (1, "B")}
    only_b = DetectorSet({"A": detectors.models["A"], "B": detectors.models["B"]})
    assert only_b.predict_with_fallback(sessions).select("config_used").distinct().collect()[0][0] == "B"
    lost = broken.withColumn("embedding", F.when(F.col("sid") != 1, F.col("embedding")))
    row = detectors.predict_with_fallback(lost).filter("sid = 1").first()
    assert row.config_used is None and row.probs is None and row.y_pred is None


def test_never_falls_back_to_statistics_alone(sessions, detectors):
    with pytest.raises(ModelNotLoadedError):
        DetectorSet({"A": detectors.models["A"]}).predict_with_fallback(sessions)
    with pytest.raises(ModelNotLoadedError):
        DetectorSet().predict(sessions, "C")
    with pytest.raises(FeatureDimensionError):
        detectors.predict(sessions.drop("embedding"), "C")


def test_models_are_saved_and_loaded(spark, sessions, detectors, tmp_path):
    detectors.save(spark, str(tmp_path))
    loaded = DetectorSet.load(spark, str(tmp_path))
    assert sorted(loaded.models) == ["A", "B", "C"] and loaded.models["C"].classes == [0, 4, 10]
    a = detectors.predict(sessions, "C").select("sid", "y_pred")
    assert a.exceptAll(loaded.predict(sessions, "C").select("sid", "y_pred")).count() == 0
    assert DetectorSet.load(spark, str(tmp_path / "none")).models == {}


def test_training_needs_two_classes(sessions):
    with pytest.raises(ValueError):
        ClassModel.fit(sessions.filter("label = 0"), list(STAT_NAMES))


def test_unseen_classes(sessions):
    assert [r.label for r in unseen_classes(sessions.filter("label != 4"), sessions).collect()] == [4]


def test_importance_finds_the_useful_column(spark, sessions):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 2), float(i % 2) + float(rng.normal(0, 0.01)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "sid long, label int, good double, noise double")
    model = ClassModel.fit(df, ["good", "noise"], numTrees=5, maxDepth=3)
    first = E.model_importance(spark, model.trees, ["good", "noise"], 1).first()
    assert first.feature == "good"
    lost = {r.feature: r.importance for r in E.permutation_importance(
        model.score_index, E.sample_rows(df, 200, "sid"), ["good", "noise"], "label", "sid").collect()}
    assert lost["good"] > 0.3 and abs(lost["noise"]) < 0.1
    moved = E.occlusion(model.score_index, df, ["good", "noise"], {"good": 0.5, "noise": 0.0}, "sid", 1)
    assert moved.count() == 300 and moved.filter("feature = 'good'").count() > 250


def test_event_weights(spark):
    flows = spark.createDataFrame([(1, 0, p, float(p == 3)) for p in range(5)] + [(2, 0, p, 1.0) for p in range(4)],
                                  "host long, session_idx long, pos int, x double")
    weights = E.event_weights(flows, FeatureScaler({"x": 1.0}, {"x": 1.0}))
    got = {(r.host, r.pos): r.weight for r in weights.collect()}
    assert got[(1, 3)] == 0.0 and got[(1, 0)] == 0.25 and got[(2, 0)] == 0.25
    top = [r.pos for r in E.top_events(weights, 2).filter("host = 1").orderBy("rank").collect()]
    assert top == [0, 1]
    entropy = {r.host: r.attention_entropy for r in E.weight_entropy(weights).collect()}
    assert entropy[2] == pytest.approx(np.log(4), abs=1e-6)


def test_session_embedding_width(spark):
    rng = np.random.default_rng(2)
    rows = [(h, 0, p, *[float(x) for x in rng.normal(size=2)]) for h in range(30) for p in range(5)]
    flows = spark.createDataFrame(rows, "host long, session_idx long, pos int, a double, b double")
    embedder = SessionEmbedder.fit(flows, FeatureScaler.fit(flows, ["a", "b"]), 3)
    out = embedder.transform(flows)
    assert out.count() == 30 and out.first().embedding.size == 3 and out.columns == ["host", "session_idx", "embedding"]


def test_session_embedder_fitted_on_a_summary_that_is_there(spark):
    rng = np.random.default_rng(5)
    rows = [(h, 0, p, *[float(x) for x in rng.normal(size=2)]) for h in range(30) for p in range(5)]
    flows = spark.createDataFrame(rows, "host long, session_idx long, pos int, a double, b double")
    scaler = FeatureScaler.fit(flows, ["a", "b"])
    summary = SessionEmbedder.summarise(flows, scaler)
    one, two = SessionEmbedder.fit(flows, scaler, 3), SessionEmbedder.fit_summary(summary, scaler, 3)
    vectors = [[r.embedding.toArray() for r in e.embed(summary).orderBy("host").collect()] for e in (one, two)]
    assert np.allclose(*vectors) and len(vectors[0]) == 30


def test_request_rows_clean_only_the_columns_asked_for(spark):
    odd = [None, float("nan"), float("inf"), float("-inf"), 5e12, -5e12, 1.0, 0.0]
    rows = [(i, 0, [odd[(i * 7 + j * j) % len(odd)] for j in range(78)], 1 + i % 4) for i in range(24)]
    requests = spark.createDataFrame(rows, "request_id long, pos int, features array<double>, log_type int")
    cleaned = F.expr(f"transform(features, v -> {clean_sql('v', 'bound')})")
    arrays = requests.withColumn("f", cleaned).select("request_id", realign_array("f", "log_type").alias("a")).orderBy("request_id").collect()
    whole = aligned_requests(requests)
    assert [list(r)[3:] for r in whole.orderBy("request_id").collect()] == [r.a for r in arrays]
    read = {"log_type", "zeek_conn_state", "idle_mean", *stat_inputs(TRAINED_FEATURES)}
    few = aligned_requests(requests, read)
    assert set(few.columns) == {"request_id", "pos", "_given", *read}
    values = [c for c in few.columns if c != "_given"]  # a given NaN equals nothing
    assert few.select(*values).orderBy("request_id").collect() == whole.select(*values).orderBy("request_id").collect()
    assert aligned_requests(requests, ["log_type", "flow_duration"]).columns == ["request_id", "pos", "_given", "flow_duration", "log_type"]
    with pytest.raises(Exception, match="78 feature columns expected"):
        aligned_requests(requests.withColumn("features", F.slice("features", 1, 77)), ["flow_duration"]).collect()


def test_statistics_need_no_other_columns(spark):
    names = list(TRAINED_FEATURES)
    rows = [(i % 3, *[float((i * (j + 3)) % 11) for j in range(len(names))]) for i in range(40)]
    flows = spark.createDataFrame(rows, "request_id long, " + ", ".join(f"`{c}` double" for c in names))
    needed = stat_inputs(names)
    assert 0 < len(needed) < len(names)
    for bounded in (True, False):
        whole, few = (session_stats(x, ["request_id"], bounded=bounded).orderBy("request_id").collect()
                      for x in (flows, flows.select("request_id", *needed)))
        assert whole == few


def test_labels_of_windows_are_worked_out_once_for_the_split(spark):
    rows = [(h * 100 + i, h, i, int(h % 2 and i % 7 == 0) * 4) for h in range(6) for i in range(45)]
    flows = spark.createDataFrame(rows, "flow_id long, host long, ts long, label_id int")
    split = split_sessions(flows)
    assert any("session-labels" in f for f in split.inputFiles())
    per_session = split.groupBy("host", "session_idx").agg(F.count("*").alias("n"), F.countDistinct("split").alias("s")).collect()
    assert len(per_session) == 12 and all((r.n, r.s) == (20, 1) for r in per_session)


def test_flow_classifier_learns_stops_early_and_is_stored(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        c = [0, 0, 0, 4, 10][i % 5]
        seen = c if rng.random() < 0.9 else int(rng.choice([0, 4, 10]))  # a tenth of the labels says nothing
        rows.append((i, seen, i % 4 == 0, float(rng.normal(c, 0.4)), float(rng.normal(0, 1))))
    flows = spark.createDataFrame(rows, "flow_id long, label_id int, validation boolean, a double, b double")
    model = FlowClassifier.fit(flows, ["a", "b"], maxIter=25)
    assert model.classes == [0, 4, 10] and all(n < 25 for n in model.rounds().values())
    scored = model.predict(flows.filter("validation")).collect()
    assert np.mean([r.y_pred == r.label_id for r in scored]) > 0.85
    for r in scored:
        assert len(r.probs) == 15 and abs(sum(r.probs) - 1) < 1e-9 and r.probs[r.y_pred] == max(r.probs)
    model.save(spark, str(tmp_path / "flow"))
    again = FlowClassifier.load(spark, str(tmp_path / "flow")).predict(flows.filter("validation")).collect()
    assert [r.probs for r in sorted(again, key=lambda r: r.flow_id)] == [r.probs for r in sorted(scored, key=lambda r: r.flow_id)]
    with pytest.raises(FeatureDimensionError):
        model.predict(flows.drop("b"))
    with pytest.raises(ValueError):
        FlowClassifier.fit(flows.filter("label_id = 0"), ["a", "b"])


def test_flow_classifier_counts_only_inputs_that_vary(spark, monkeypatch):
    rows = [(i, [0, 4][i % 2], i % 4 == 0, float(i % 2), 7.0, 2.0 if i == 3 else 1.0, -0.0 if i % 3 else 0.0) for i in range(80)]
    flows = spark.createDataFrame(rows, "flow_id long, label_id int, validation boolean, a double, same double, gap double, zero double")
    inputs = ["same", "a", "zero", "gap"]
    model = FlowClassifier.fit(flows, inputs, maxIter=3)
    assert model.inputs == inputs and model.stages[0].getInputCols() == ["a", "gap"]
    few = [r.probs for r in model.predict(flows).orderBy("flow_id").collect()]
    monkeypatch.setattr("flowspark.plans.models._varying", lambda rows, vector, width: list(range(width)))
    every = FlowClassifier.fit(flows, inputs, maxIter=3)
    assert [r.probs for r in every.predict(flows).orderBy("flow_id").collect()] == few
    monkeypatch.undo()
    assert FlowClassifier.fit(flows, ["same", "zero"], maxIter=2).stages[0].getInputCols() == ["same", "zero"]
    with pytest.raises(ValueError):
        FlowClassifier.fit(flows.limit(0), inputs)


def test_flow_classifier_fits_as_many_classes_at_once_as_memory_holds(spark, monkeypatch):
    flows = spark.createDataFrame([(i, [0, 4, 10][i % 3], i % 4 == 0, float(i % 3)) for i in range(60)],
                                  "flow_id long, label_id int, validation boolean, a double")
    assert 0 < free_memory(spark) < 2 ** 40
    used = []

    class Pool(ThreadPool):
        def __init__(self, n):
            used.append(n)
            super().__init__(n)

    monkeypatch.setattr("flowspark.plans.models.ThreadPool", Pool)
    # 45 training rows of one column
    for free in (0, 2.5 * 45 * (4 + COPY_BYTES), 1e9):
        monkeypatch.setattr("flowspark.plans.models.free_memory", lambda spark, free=free: int(free))
        FlowClassifier.fit(flows, ["a"], maxIter=1)
    FlowClassifier.fit(flows, ["a"], maxIter=1, parallel=3)
    assert used == [1, 2, 4, 3]


def test_report_of_flows_scores_them_once(spark, sf_dir, monkeypatch):
    kept = []

    def keep(df, name):
        kept.append(name)
        return materialise(df, name)

    monkeypatch.setattr("flowspark.catalog.model_queries.materialise", keep)
    monkeypatch.setattr("flowspark.plans.models.BOOSTING", {**BOOSTING, "maxIter": 1})
    report = flow_classifier(spark, sf_dir)
    assert kept == ["aligned-flows", "scored-flows"] and report.inputFiles() and all("scored-flows" in f for f in report.inputFiles())


def test_rows_are_dealt_evenly_in_a_fixed_order(spark):
    rows = spark.range(1000, numPartitions=1).selectExpr("id", "0 AS label")
    assert evenly(rows, 1000, ["id"], 1000) is rows
    parts = evenly(rows, 1000, ["id"], 100).rdd.glom().collect()
    assert len(parts) == 10 and max(map(len, parts)) < 200 and sum(map(len, parts)) == 1000
    assert all(p == sorted(p) for p in parts)


def test_copies_of_rows_are_scored_by_several_tasks(spark, monkeypatch):
    rows = spark.range(200, numPartitions=1).selectExpr("id", "cast(id % 2 as int) AS label", "cast(id % 2 as double) AS a", "1.0D AS b")
    rules = {"prediction": F.col("a"), "probability": F.array(1 - F.col("a"), F.col("a")), "task": F.spark_partition_id()}
    seen = []

    def score(copies):
        scored = copies.withColumns(rules)
        seen.append(scored)
        return scored

    def both():
        lost = E.permutation_importance(score, rows, ["a", "b"], "label", "id").collect()
        moved = E.occlusion(score, rows, ["a", "b"], {"a": 0.5, "b": 0.0}, "id").collect()
        return sorted(map(str, lost)), sorted(map(str, moved))

    whole = both()
    monkeypatch.setattr(E, "COPIED_ROWS", 20)
    assert both() == whole
    for scored in seen[2:]:
        per_task = [r["n"] for r in scored.groupBy("task").agg(F.count("*").alias("n")).collect()]
        assert len(per_task) > 5 and max(per_task) < 200 and sum(per_task) == 600


def test_typed_errors_of_scoring_and_enrichment(spark, sessions):
    detectors = DetectorSet.fit(sessions, configs=("A",), numTrees=3, maxDepth=2)
    with pytest.raises(InferenceError) as caught:
        detectors.predict(sessions.withColumn("stat_syn_ratio", F.lit("text")), "A")
    assert caught.value.config == "A" and caught.value.__cause__ is caught.value.cause
    with pytest.raises(EnrichmentError) as caught:
        enrich_alerts(sessions.select("sid"), KnowledgeSearch.build(spark))
    assert not caught.value.fatal
    with pytest.raises(EnrichmentError):
        enrich_alerts(sessions, None)
