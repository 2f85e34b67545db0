import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators.ordering import with_row_index
from flowspark.operators.sampling import next_event_pairs, pad_sessions
from flowspark.operators.sessions import (
    benign_sessions, session_arrays, session_summary, session_truth, sessionize, truncate_sessions,
)
from flowspark.operators.stats import session_stats
from flowspark.schema import STAT_NAMES

START = dt.datetime(2024, 3, 31, 0, 30)


def skewed(spark, rows=3000, same_time=False):
    """Host 1 has most rows; with same_time a third of them share one time stamp."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(rows):
        host = 1 if rng.random() < 0.7 else int(rng.integers(2, 40))
        second = 500 if same_time and rng.random() < 0.5 else int(rng.integers(0, 4000))
        data.append((i, host, START + dt.timedelta(seconds=second), int(rng.integers(0, 3))))
    return spark.createDataFrame(data, "flow_id long, host long, ts timestamp_ntz, label_id int").repartition(7)


@pytest.mark.parametrize("keys", [["host"], []])
@pytest.mark.parametrize("same_time", [False, True])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "long"])
def test_slices_give_the_plain_numbers(spark, keys, same_time, kind):
    df = skewed(spark, same_time=same_time)
    if kind == "long":
        df = df.withColumn("ts", F.unix_seconds(F.col("ts").cast("timestamp")))
    else:
        df = df.withColumn("ts", F.col("ts").cast(kind))
    plain = with_row_index(df, keys, "ts", "flow_id", total="n")
    sliced = with_row_index(df, keys, "ts", "flow_id", total="n", hot_rows=50)
    assert "_slice" in sliced._jdf.queryExecution().toString()
    assert plain.exceptAll(sliced).count() == 0 and sliced.count() == df.count()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_null_can_be_the_hot_key(spark, kind):
    df = skewed(spark).withColumn("host", F.when(F.col("host") != 1, F.col("host")).cast(kind))
    plain = with_row_index(df, ["host"], "ts", "flow_id", total="n")
    sliced = with_row_index(df, ["host"], "ts", "flow_id", total="n", hot_rows=50)
    assert plain.exceptAll(sliced).count() == 0 and sliced.count() == df.count()
    assert sliced.columns == plain.columns


def test_hot_key_is_spread(spark):
    df = skewed(spark, same_time=True)
    sliced = with_row_index(df, ["host"], "ts", "flow_id", hot_rows=50)
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "_subslice" in plan


@pytest.mark.parametrize("size, stride", [(20, 20), (20, 10), (20, 7), (5, 8), (1, 1), (3, 1)])
def test_windows_against_a_loop(spark, size, stride):
    df = skewed(spark, 600)
    got = {}
    for r in sessionize(df, size, stride, hot_rows=100).collect():
        got.setdefault((r.host, r.session_idx), {})[r.pos] = r.flow_id
    want = {}
    rows = sorted(df.collect(), key=lambda r: (r.host, r.ts, r.flow_id))
    for host in {r.host for r in rows}:
        ids = [r.flow_id for r in rows if r.host == host]
        start, number = 0, 0
        while start + size <= len(ids):
            want[(host, number)] = dict(enumerate(ids[start:start + size]))
            start, number = start + stride, number + 1
    assert got == want


def test_no_window_when_flows_are_too_few(spark):
    df = skewed(spark, 10)
    assert sessionize(df, 20).count() == 0


def labelled(spark, labels):
    rows = [(i, 1, START + dt.timedelta(seconds=i), c) for i, c in enumerate(labels)]
    return spark.createDataFrame(rows, "flow_id long, host long, ts timestamp_ntz, label_id int")


@pytest.mark.parametrize("labels, label, ids, majority", [
    ([0] * 20, 0, [], 0),
    ([0] * 15 + [4] * 3 + [2] * 2, 4, [2, 4], 0),
    ([4, 4, 2, 2] + [0] * 16, 2, [2, 4], 0),
    ([14] * 11 + [1] * 9, 14, [1, 14], 14),
    ([5] * 10 + [3] * 10, 3, [3, 5], 5),
    ([15] * 2 + [0] * 18, 15, [15], 0),
    ([99] * 3 + [-1] * 2 + [4] * 4 + [0] * 11, 15, [4, 15], 0),
    ([None] * 12 + [0] * 8, 0, [], None),
    ([None] * 20, None, [], None),
])
def test_session_label(spark, labels, label, ids, majority):
    flows = sessionize(labelled(spark, labels))
    row = session_summary(flows).first()
    assert (row.label, row.attack_ids, row.has_attack, row.n_flows) == (label, ids, bool(ids), 20)
    truth = session_truth(flows).first()
    assert truth.majority_id == majority and sum(truth.distribution.values()) == 20


def test_benign_windows_count_benign_flows(spark):
    found = benign_sessions(labelled(spark, [0, 1] * 30)).collect()
    assert sorted(r.flow_id for r in found) == list(range(0, 40, 2))


def test_truncation_keeps_first_positions(spark):
    cut = truncate_sessions(sessionize(labelled(spark, [0] * 20)), (3, 50))
    got = {r.n: r["count"] for r in cut.groupBy("n").count().collect()}
    assert got == {3: 3, 50: 20}


def brute_statistics(rows):
    """The 26 statistics with numpy, straight from their definitions."""
    col = lambda c: np.array([r[c] for r in rows], dtype=float)

    def entropy(v):
        p = np.unique(v.astype(int), return_counts=True)[1] / len(v)
        return float(-(p * np.log2(p)).sum())

    fwd, bwd = col("total_length_of_fwd_packets"), col("total_length_of_bwd_packets")
    fp, pk = col("total_fwd_packets"), col("total_fwd_packets") + col("total_backward_packets")
    dur, port, lt = col("flow_duration"), col("destination_port"), col("log_type")
    flags = {k: col(f"{k}_flag_count") for k in ("fin", "syn", "rst", "psh", "urg")}
    f = (sum(flags.values()) + 1e-9).sum()
    bps, iat = np.clip(col("flow_bytes_s"), 0, 1e8), np.clip(col("flow_iat_mean"), 0, 1e9)
    win = (col("init_win_bytes_forward") + col("init_win_bytes_backward")) / 2
    act, idle = col("active_mean").sum() + 1e-9, col("idle_mean").sum()
    return [
        len(rows), fwd.sum(), bwd.sum(), (fwd + bwd).mean(), (fwd + bwd).std() + 1e-9, dur.mean(), dur.std() + 1e-9,
        pk.mean(), pk.std() + 1e-9, fwd.sum() / ((fwd + bwd).sum() + 1e-9), fp.sum() / (pk.sum() + 1e-9), entropy(port),
        entropy(lt), flags["syn"].sum() / f, flags["fin"].sum() / f, flags["rst"].sum() / f, flags["psh"].sum() / f,
        flags["urg"].sum() / f, bps.mean(), bps.max(), iat.mean(), iat.std() + 1e-9, len(np.unique(port.astype(int))),
        (dur < 100000).mean(), win.mean(), idle / (act + idle),
    ]


@pytest.mark.parametrize("bounded", [True, False])
def test_statistics_against_numpy(spark, bounded):
    from flowspark.schema import FEATURES
    rng = np.random.default_rng(5)
    used = [c for c in FEATURES if not c.endswith("std")]
    data = []
    for s in range(6):
        for _ in range(20):
            v = [float(x) for x in rng.integers(0, 4, len(used)) * 10.0 ** rng.integers(-1, 9, len(used))]
            data.append((s, *v, int(rng.integers(0, 5))))
    df = spark.createDataFrame(data, "s int, " + ", ".join(f"{c} double" for c in used) + ", log_type int")
    got = {r.s: [r[c] for c in STAT_NAMES] for r in session_stats(df, ["s"], bounded=bounded).collect()}
    for s in range(6):
        want = brute_statistics([r for r in df.collect() if r.s == s])
        assert got[s] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_statistics_of_absent_columns(spark):
    row = session_stats(spark.createDataFrame([(1, 5.0)] * 3, "s int, destination_port double"), ["s"]).first()
    assert row.stat_flow_count == 3 and row.stat_syn_ratio == 0 and row.stat_unique_dst_ports == 1
    assert row.stat_short_flow_ratio == 1 and row.stat_std_duration == 1e-9


def test_padding_and_next_event(spark):
    flows = sessionize(labelled(spark, [0] * 20)).withColumn("x", F.col("pos") + 1.0).withColumn("log_type", F.lit(2))
    nested = session_arrays(flows, ["x"])
    row = pad_sessions(nested, 60, 1).first()
    assert row.length == 20 and len(row.features) == 60 and row.features[19] == [20.0] and row.features[20] == [0.0]
    assert row.padding_mask == [False] * 20 + [True] * 40 and row.log_types[:21] == [2] * 20 + [0]
    cut = pad_sessions(nested, 8, 1).first()
    assert cut.length == 8 and len(cut.features) == 8 and not any(cut.padding_mask)
    pair = next_event_pairs(flows, ["x"]).first()
    assert pair.context_length == 19 and pair.target == [20.0] and pair.context[-1] == [19.0]
    single = sessionize(labelled(spark, [0] * 2), 1).withColumn("x", F.lit(1.0))
    assert next_event_pairs(single, ["x"]).count() == 0


def test_running_statistics_are_those_of_the_first_flows(spark):
    from flowspark.operators.sessions import truncate_sessions
    from flowspark.operators.stats import prefix_stats, running_sql, session_stats

    assert running_sql("sum(a * (b + 1)) / (count(*) + 1D)", "w") == "sum(a * (b + 1)) OVER w / (count(*) OVER w + 1D)"
    flows = spark.range(47).selectExpr(
        "id % 3 AS host", "0 AS session_idx", "CAST(id div 3 AS INT) AS pos", "CAST(id * 7 % 11 AS DOUBLE) AS flow_duration",
        "CAST(id % 4 AS DOUBLE) AS destination_port", "CAST(id % 2 AS DOUBLE) AS syn_flag_count", "id % 5 AS log_type")
    points = [1, 4, 15, 16, 99]
    want = session_stats(truncate_sessions(flows, points, "n_flows"), ["host", "session_idx", "n_flows"])
    got = prefix_stats(flows, points)
    # a cut longer than the session has no row of its own
    want = {(r.host, r.n_flows): [round(x, 9) for x in r[3:]] for r in want.collect() if r.n_flows <= r.stat_flow_count}
    assert {(r.host, r.n_flows): [round(x, 9) for x in r[3:]] for r in got.collect()} == want
