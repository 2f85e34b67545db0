import datetime as dt
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.catalog.adapters import enriched
from flowspark.catalog.stream_queries import stream_sessions_resumed
from flowspark.functions.protocol import add_protocol_columns
from flowspark.operators.counters import detection_counters
from flowspark.operators.scaling import FeatureScaler
from flowspark.operators.sessions import five_minute_windows, session_summary, sessionize
from flowspark.schema import FEATURES, N_CLASSES
from flowspark.sources.alert_table import AlertTable
from flowspark.streaming import replay as R
from flowspark.streaming.sessions import _cut, _cut_hosts, _in_line, _packed, split_valid_sessions, start_sessions
from flowspark.streaming.sinks import read_counters, session_alerts, start_alerts, start_counters, start_table, write_stream_summary
from flowspark.sources.stores import read_json

START = dt.datetime(2024, 1, 1)
SCHEMA = "flow_id long, host long, ts timestamp_ntz, destination_port double, label_id int"


def flows(spark, n=900):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        host = 1 if rng.random() < 0.5 else int(rng.integers(2, 9))
        rows.append((i, host, START + dt.timedelta(seconds=i), float(rng.choice([53, 80, 9999])), int(rng.choice([0, 0, 2]))))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def arriving(spark, tmp_path):
    """Flows as four files that arrive one after the other."""
    df = flows(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(4):
        staged = str(tmp_path / f"part{part}")
        df.filter(f"flow_id >= {part * 225} AND flow_id < {(part + 1) * 225}").coalesce(1).write.parquet(staged)
        name = [f for f in os.listdir(staged) if f.endswith(".parquet")][0]
        os.link(f"{staged}/{name}", folder / f"{part}.parquet")
        stamp = time.time() - 100 + part * 10
        os.utime(folder / f"{part}.parquet", (stamp, stamp))
    return df, str(folder)


def _link(folder, staged, number):
    """A written part arrives as the file of that number."""
    name = [f for f in os.listdir(staged) if f.endswith(".parquet")][0]
    os.link(f"{staged}/{name}", f"{folder}/{number}.parquet")
    stamp = time.time() - 1000 + number * 10
    os.utime(f"{folder}/{number}.parquet", (stamp, stamp))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_streamed_windows_equal_batch_windows_after_a_restart(spark, tmp_path, kind):
    df = flows(spark).withColumns({"ts": F.col("ts").cast(kind), "host": F.when(F.col("host") != 8, F.col("host")),
                                   "label_id": F.when(F.col("flow_id") % 7 != 0, F.col("label_id"))})
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    for run in ((0, 1), (2, 3)):
        for part in run:
            staged = str(tmp_path / f"part{part}")
            df.filter(f"flow_id >= {part * 225} AND flow_id < {(part + 1) * 225}").coalesce(1).write.parquet(staged)
            _link(folder, staged, part)
        query = start_sessions(R.stream_parquet(spark, str(folder), df.schema).drop("source_file"), out, checkpoint)
        query.awaitTermination()
        assert query.lastProgress["batchId"] >= run[-1]
    columns = ["flow_id", "host", "ts", "label_id", "session_idx", "pos"]
    got, want = spark.read.parquet(out).select(*columns), sessionize(df).select(*columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_state_holds_less_than_a_window_of_a_host(spark):
    rows = flows(spark, 300).toPandas()
    full, rest, done = _cut(rows, 20, 3)
    assert (len(full), len(rest), done) == (300, 0, 18) and list(full["session_idx"].unique()) == list(range(3, 18))
    full, rest, done = _cut(rows.iloc[:19], 20, 3)
    assert (len(full), len(rest), done) == (0, 19, 3)


def test_waiting_rows_come_before_those_of_a_batch_in_order():
    def rows(ids, times, text=None):
        return pd.DataFrame({"flow_id": ids, "ts": pd.to_datetime(times, unit="s"), "x": [float(i) for i in ids], "text": text or ["a"] * len(ids)})

    names = ["flow_id", "ts", "x", "text"]
    first = _in_line(rows([5, 3, 4], [2, 2, 1], ["e", None, "d"]), names, "ts", "flow_id", None)
    assert list(first["flow_id"]) == [4, 3, 5] and list(first["text"]) == ["d", None, "e"]
    second = rows([9, 8, 7, 6], [4, 3, 3, None])
    both = _in_line(second, names, "ts", "flow_id", _packed(first))
    assert list(both["flow_id"]) == [4, 3, 5, 7, 8, 9, 6] and both["ts"].isna().tolist() == [False] * 6 + [True]
    by_text = _in_line(rows([1, 2, 3], [1, 1, 1], ["b", None, "a"]), names, "text", "flow_id", None)
    assert list(by_text["flow_id"]) == [3, 1, 2]


def test_idle_hosts_lose_what_waits_but_keep_their_numbers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def hour(number, host, first, n, at):
        rows = [(first + i, host, START + dt.timedelta(hours=at, seconds=i), 80.0, 0) for i in range(n)]
        staged = str(tmp_path / f"hour{number}")
        spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(staged)
        _link(folder, staged, number)

    schema = spark.createDataFrame([], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")).schema
    hour(0, 1, 0, 30, 0)       # one window, ten flows wait
    hour(1, 2, 100, 5, 5)      # host 2 moves the clock on; host 1 falls idle with the next batch
    hour(2, 2, 200, 5, 6)
    hour(3, 1, 300, 20, 7)     # back again: a window of its own, numbered on
    stream = R.stream_parquet(spark, str(folder), schema)
    start_sessions(stream, str(tmp_path / "out"), str(tmp_path / "cp"), idle="1 hour").awaitTermination()
    got = {(r.flow_id, r.session_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.host == 1}
    assert got == {(i, 0) for i in range(20)} | {(300 + i, 1) for i in range(20)}


def called(df):
    y = F.when(F.col("destination_port") == 80, 2).otherwise(0)
    probs = F.array(*[F.when(y == c, 0.9).otherwise(0.1 / 14) for c in range(N_CLASSES)])
    return df.withColumns({"y_pred": y, "probs": probs})


def test_running_counters(spark, arriving, tmp_path):
    df, folder = arriving
    events = R.detection_events(called(R.stream_parquet(spark, folder, df.schema)))
    kept = str(tmp_path / "counters")
    start_counters(events, kept, str(tmp_path / "cp")).awaitTermination()
    batch = detection_counters(R.detection_events(called(df))).collect()
    assert read_counters(spark, kept).collect() == batch
    # a batch that died before its marker does not count, and nothing depends on the driver's memory
    (tmp_path / "counters" / "batch=99").mkdir()
    assert read_counters(spark, kept).collect() == batch
    with pytest.raises(FileNotFoundError):
        read_counters(spark, str(tmp_path / "none"))
    write_stream_summary(R.detection_events(called(df)), 10, str(tmp_path / "summary"))
    assert read_json(spark, str(tmp_path / "summary")).first().flows_per_second == 90.0


def test_alert_stream(spark, arriving, tmp_path):
    df, folder = arriving
    events = R.detection_events(called(R.stream_parquet(spark, folder, df.schema)))
    alerts = session_alerts(events.select(
        (F.col("flow_id") % 100).alias("session_no"), F.col("flow_id").cast("double").alias("ts"), "attack_id", "attack_name",
        "confidence", (F.col("ground_truth_id") != 0).alias("has_attack"), F.lit(20).alias("n_flows")))
    table = AlertTable(spark, str(tmp_path / "alerts"), max_alerts=60)
    start_alerts(alerts, table, str(tmp_path / "cp")).awaitTermination()
    rows = table.read().collect()
    # 900 flows share 100 ids; the newest 60 ids stay, each with its last flow.
    assert sorted(r.ts for r in rows) == [float(i) for i in range(840, 900)]
    assert all(r.alert_uuid == f"stream-{int(r.ts) % 100}" and r.verdict in ("TP", "FP", "FN", "TN") for r in rows)


def test_features_only_pass(spark, arriving, tmp_path):
    df, folder = arriving
    start_table(R.feature_events(R.stream_parquet(spark, folder, df.schema)), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "t")).first()
    assert (row.attack_id, row.attack_name, row.confidence, row.probabilities, row.correct) == (-1, "", 0.0, [], None)


def test_failed_batches_fall_back_and_are_marked(spark):
    df = R.clean_stream(flows(spark, 50))
    scaler = FeatureScaler.fit(df, FEATURES)

    def broken(raw, scaled):
        raise RuntimeError("no model")

    rows = R.score_stream(df, model_fn=broken, scaler=scaler).collect()
    assert {r.score_error for r in rows} == {"RuntimeError: no model"}
    assert all(r.score_failed and r.attack_id == 0 and r.confidence == 1.0 and sum(r.probabilities) == 1.0 for r in rows)

    def port(raw, scaled):
        assert raw.shape == scaled.shape and raw.shape[1] == 78
        classes = np.where(raw[:, 0] == 80, 2, 0)
        return classes, np.eye(N_CLASSES)[classes]

    rows = R.score_stream(df, model_fn=port, scaler=scaler).collect()
    assert {r.attack_name for r in rows} == {"BENIGN", "DDoS"} and not any(r.score_failed for r in rows)


def test_csv_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("Destination Port,Flow Duration,Label\n80,Infinity,DDoS\nx,5,Web Attack \x96 XSS\n".encode("latin-1"))
    stream = R.stream_csv(spark, str(tmp_path / "in"), ["destination_port", "flow_duration", "label"])
    start_table(R.clean_stream(stream), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    rows = sorted((r.destination_port, r.flow_duration, r.label_id, r.source_file) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert rows == [(0.0, 5.0, 14, "a.csv"), (80.0, 0.0, 2, "a.csv")]


def test_time_windows_on_a_stream(spark, arriving, tmp_path):
    df, folder = arriving
    stream = R.stream_parquet(spark, folder, df.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    sized = stream.withColumns({"total_length_of_fwd_packets": F.lit(1.0), "total_length_of_bwd_packets": F.lit(2.0)})
    found = five_minute_windows(sized, watermark="10 minutes")
    query = found.writeStream.format("memory").queryName("win").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("win").collect()
    # 900 seconds of flows: only the first five minutes lie behind the watermark.
    assert sum(r.n_flows for r in rows) == 0 or {r.window_start for r in rows} <= {START, START + dt.timedelta(minutes=5)}
    batch = five_minute_windows(df.withColumns({"total_length_of_fwd_packets": F.lit(1.0), "total_length_of_bwd_packets": F.lit(2.0)}))
    assert sum(r.n_flows for r in batch.collect()) == 900


def test_quarantine(spark):
    good = sessionize(add_protocol_columns(flows(spark)))
    bad = good.withColumn("destination_port", F.when((F.col("host") != 1) | (F.col("pos") != 3), F.col("destination_port")))
    valid, failed = split_valid_sessions(bad, ["destination_port"])
    n = good.filter("host = 1").select("session_idx").distinct().count()
    assert failed.count() == n and valid.filter("host = 1").count() == 0
    assert valid.count() == good.filter("host != 1").count()
    short, wrong = split_valid_sessions(good.filter("pos < 10"), ["destination_port"])
    assert short.count() == 0 and wrong.select("reason").distinct().first()[0] == "session size"


def test_resumed_windows_of_a_table_of_many_files(spark, tmp_path):
    rows = [(i, START + dt.timedelta(seconds=i), i % 3 if i % 5 else None, "error" if i % 7 else "view", float(i), f'{{"k": {i % 40}}}')
            for i in range(1200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    # the files hold rows of all hosts and times, so that the order in which they arrive says nothing
    events.repartition(6, F.xxhash64("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    names = ["host", "session_idx", "label", "has_attack", "attack_ids", "n_flows"]
    ids = F.array_join(F.transform("attack_ids", lambda c: c.cast("string")), ",")
    want = session_summary(sessionize(enriched(spark, str(tmp_path)))).withColumn("attack_ids", ids).select(*names)
    got = stream_sessions_resumed(spark, str(tmp_path)).select(*names)
    assert got.count() == want.count() > 50 and got.exceptAll(want).count() == 0


def test_hosts_that_share_a_state_keep_their_own_windows(spark, tmp_path):
    big = 2 ** 60
    rows = [(None if i == 500 else big + i, None if i % 4 == 3 else big + i % 4, START + dt.timedelta(seconds=i), 80.0, None if i % 6 else 2)
            for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        staged = str(tmp_path / f"part{part}")
        low = START + dt.timedelta(seconds=part * 200)
        df.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(low + dt.timedelta(seconds=200)))).coalesce(1).write.parquet(staged)
        _link(folder, staged, part)
    start_sessions(R.stream_parquet(spark, str(folder), df.schema), str(tmp_path / "out"), str(tmp_path / "cp"), states=1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(*df.columns, "session_idx", "pos")
    want = sessionize(df).select(*got.columns)
    assert got.count() == want.count() == 560 and got.exceptAll(want).count() == 0


def test_cut_of_many_hosts():
    rows = pd.DataFrame({"host": [7, 5, 7, 5, 7, 5, 7, 9], "x": range(8)})
    full, rest, done = _cut_hosts(rows, 2, "host", None)
    assert sorted(zip(full["host"], full["session_idx"], full["pos"], full["x"])) == [(5, 0, 0, 1), (5, 0, 1, 3), (7, 0, 0, 0), (7, 0, 1, 2), (7, 1, 0, 4), (7, 1, 1, 6)]
    assert list(rest["x"]) == [5, 7]
    full, rest, _ = _cut_hosts(pd.concat([rest, pd.DataFrame({"host": [4, 5, 7, 7], "x": [8, 9, 10, 11]})]), 2, "host", done)
    assert sorted(zip(full["host"], full["session_idx"], full["x"])) == [(5, 1, 5), (5, 1, 9), (7, 2, 10), (7, 2, 11)] and list(rest["x"]) == [7, 8]
