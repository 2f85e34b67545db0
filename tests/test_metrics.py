import numpy as np
import pytest

from flowspark.operators import counters as C
from flowspark.operators import metrics as M
from flowspark.schema import THRESHOLDS


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        true = int(rng.choice([0, 0, 0, 2, 4, 10]))
        p = rng.dirichlet(np.ones(15) * 0.4)
        p[true] += rng.random()
        p = np.round(p / p.sum(), 2)  # coarse scores give ties
        rows.append((i, true, int(p.argmax()), [float(x) for x in p]))
    df = spark.createDataFrame(rows, "session_id long, y_true int, y_pred int, probs array<double>").cache()
    y, h, p = (np.array(v) for v in zip(*[(r[1], r[2], r[3]) for r in rows]))
    return df, y, h, p


def pair_auc(positive, score):
    """Share of positive / negative pairs in the right order, ties as one half."""
    pos, neg = score[positive], score[~positive]
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size


def step_average_precision(positive, score):
    total, before, area = positive.sum(), 0, 0.0
    for t in sorted(set(score), reverse=True):
        called = score >= t
        tp = (positive & called).sum()
        area += (tp - before) / total * tp / called.sum()
        before = tp
    return area


def test_confusion_adds_up(scored):
    df, y, h, _ = scored
    cells = M.confusion_matrix(df).collect()
    assert len(cells) == 225 and sum(c.n for c in cells) == len(y)
    for c in cells:
        assert c.n == ((y == c.y_true) & (h == c.y_pred)).sum()


def test_summary(scored):
    df, y, h, _ = scored
    row = M.summary_metrics(df).first()
    classes = sorted(set(y) | set(h))
    f1 = {c: 2 * ((y == c) & (h == c)).sum() / ((y == c).sum() + (h == c).sum()) for c in classes}
    assert row.accuracy == pytest.approx((y == h).mean()) == pytest.approx(row.recall_weighted)
    assert row.f1_macro == pytest.approx(np.mean(list(f1.values())))
    assert row.f1_weighted == pytest.approx(sum(f1[c] * (y == c).mean() for c in classes))
    assert (row.n_samples, row.n_attacks, row.n_benign) == (len(y), (y != 0).sum(), (y == 0).sum())


def test_report_has_two_macro_averages(scored):
    df = scored[0].filter("y_pred IN (0, 2, 4, 10)")
    report = {r["class"]: r for r in M.class_report(df).collect()}
    assert len(report) == 18 and report["Heartbleed"].support == 0
    assert report["macro avg"].f1 < M.summary_metrics(df).first().f1_macro


@pytest.mark.parametrize("slices", [1, 3, 4096])
def test_curves_do_not_depend_on_slices(scored, slices, monkeypatch):
    df, y, _, p = scored
    monkeypatch.setattr(M.cumulate_scores, "__defaults__", ((), slices))
    assert M.average_precision(df).first()[0] == pytest.approx(step_average_precision(y != 0, np.round(1 - p[:, 0], 9)))
    present = sorted(set(y))
    norm = np.round(p / np.maximum(p[:, present].sum(axis=1, keepdims=True), 1e-10), 9)
    want = {c: pair_auc(y == c, norm[:, c]) for c in present}
    got = {r.class_id: r.auc for r in M.one_vs_rest_auc(df).collect()}
    assert got == pytest.approx(want)
    weighted = sum(want[c] * (y == c).sum() for c in present) / len(y)
    assert M.weighted_auc(df).first()[0] == pytest.approx(weighted)


def test_auc_needs_two_classes(scored):
    df, *_ = scored
    assert M.weighted_auc(df.filter("y_true = 2")).first()[0] is None


def test_threshold_rows(scored):
    df, y, _, p = scored
    rows = {r.threshold: r for r in M.threshold_sweep(df).collect()}
    assert sorted(rows) == THRESHOLDS
    score = np.round(1 - p[:, 0], 9)
    for t, r in rows.items():
        assert (r.tp, r.fp) == (((y != 0) & (score >= t)).sum(), ((y == 0) & (score >= t)).sum())
        assert r.tp + r.fn == (y != 0).sum() and r.fp + r.tn == (y == 0).sum()


def test_calibration_leaves_out_full_confidence(spark):
    rows = [(0, 0, [1.0] + [0.0] * 14), (0, 0, [0.95] + [0.0] * 14), (1, 0, [0.3] + [0.0] * 14)]
    df = spark.createDataFrame(rows, "y_true int, y_pred int, probs array<double>")
    bins = {r.bin_lower: r for r in M.calibration(df).collect()}
    # 0.3 lies below the third edge, which is 3 * 0.1 in floating point.
    assert sorted(bins) == [0.2, 0.9] and bins[0.9].n_samples == 1
    row = M.calibration_error(df).first()
    assert row.n_total == 3 and row.ece == pytest.approx((0.05 + 0.3) / 3, abs=1e-4)


def test_detection_rates_and_stages(scored):
    df, y, h, _ = scored
    for r in M.detection_rates(df).collect():
        assert r.true_count == (y == r.class_id).sum() and r.class_id != 0
        assert r.false_positives == ((y != r.class_id) & (h == r.class_id)).sum()
    stages = {r.stage: r for r in M.stage_coverage(df).collect()}
    assert set(stages) == {"Impact", "Reconnaissance"}
    assert stages["Impact"].total_samples == ((y == 2) | (y == 4)).sum() and len(stages["Impact"].attacks) == 2


def test_exemplars(scored):
    df, y, h, p = scored
    for r in M.best_exemplars(df).collect():
        right = [(p[i][y[i]], -i) for i in range(len(y)) if y[i] == h[i] == r.class_id]
        assert (r.confidence, -r.session_id) == max(right)


def test_false_positive_profile_without_any(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (0, 0, 4.0)], "y_true int, y_pred int, s double")
    row = M.false_positive_profile(df, ["s"]).first()
    assert (row.fp_mean, row.fp_std, row.tn_mean, row.tn_std) == (0.0, 0.0, 3.0, 1.0)


def test_empty_predictions(spark):
    empty = spark.createDataFrame([], "session_id long, y_true int, y_pred int, probs array<double>")
    assert M.average_precision(empty).first()[0] == 0.0
    assert sum(r.n for r in M.confusion_matrix(empty).collect()) == 0
    assert [r.tp for r in M.threshold_sweep(empty).collect()] == [0] * 7


def test_counters(spark):
    rows = [(1, 2), (1, 0), (0, 2), (0, 0), (None, 5), (None, 0)]
    df = spark.createDataFrame(rows, "ground_truth_id int, attack_id int")
    row = C.detection_counters(df).first()
    assert (row.total_flows, row.total_attacks, row.total_benign) == (6, 3, 3)
    assert (row.tp, row.fp, row.fn, row.tn, row.detection_rate, row.false_positive_rate) == (1, 1, 1, 1, 0.5, 0.5)
    assert C.throughput(C.detection_counters(df), 2).first().flows_per_second == 3.0
    assert {r.attack_name: r.n for r in C.attack_counts(df).collect()} == {"DDoS": 2, "DoS Slowhttptest": 1}
