import gzip
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from flowspark.operators.counters import recent_alerts
from flowspark.operators.scaling import FeatureScaler
from flowspark.operators.sessions import sessionize
from flowspark.plans.embedding import TextEmbedder
from flowspark.schema import FEATURES, RAW_FEATURES
from flowspark.sources import alert_table as A
from flowspark.sources import files, stores
from flowspark.sources.flow_csv import csv_report, header_names, load_directory, load_flows, load_listed

# Header as the files have it: most names start with a space, one name is there twice.
HEADER = [f" {n}" if i % 3 else n for i, n in enumerate(RAW_FEATURES)]
HEADER[RAW_FEATURES.index("Fwd Header Length.1")] = " Fwd Header Length"


def line(values, label):
    cells = [str(values.get(n, 1)) for n in RAW_FEATURES]
    return ",".join(cells + [label])


def write_csv(path, rows, header=None):
    text = ",".join((header or HEADER) + [" Label"]) + "\n" + "\n".join(line(v, c) for v, c in rows) + "\n"
    path.write_bytes(text.encode("latin-1"))


@pytest.fixture
def folder(tmp_path):
    write_csv(tmp_path / "a.csv", [
        ({"Destination Port": 80, "Flow Duration": "Infinity", "Flow IAT Mean": "NaN"}, "BENIGN"),
        ({"Destination Port": "", "Flow Duration": "text", "Idle Min": "1e12"}, "Web Attack \x96 XSS"),
        ({"Destination Port": 53, "Fwd Header Length.1": 44, "Fwd Header Length": 22}, "Web Attack ï¿½ Brute Force"),
    ])
    write_csv(tmp_path / "b.csv", [({"Destination Port": i}, "ddos") for i in range(50)])
    (tmp_path / "note.txt").write_text("not a table")
    return tmp_path


def test_header_names():
    names = header_names(",".join(HEADER))
    assert names == FEATURES


def test_directory_scan(spark, folder):
    flows = load_directory(spark, str(folder))
    rows = flows.orderBy("file_order", "flow_id").collect()
    assert len(rows) == 53 and {r.source_file for r in rows} == {"a.csv", "b.csv"}
    first, second, third = rows[:3]
    assert (first.destination_port, first.flow_duration, first.flow_iat_mean, first.label_id) == (80.0, 0.0, 0.0, 0)
    assert (second.destination_port, second.flow_duration, second.idle_min, second.label_id) == (0.0, 0.0, 1e9, 14)
    assert (third.fwd_header_length, third.fwd_header_length_1, third.label_id) == (22.0, 44.0, 12)
    assert [r.destination_port for r in rows[3:]] == [float(i) for i in range(50)] and rows[4].label_id == 2


def test_row_order_carries_into_sessions(spark, folder):
    flows = load_directory(spark, str(folder))
    found = sessionize(flows, 5, keys=(), order="file_order", tie="flow_id", hot_rows=10)
    one = sorted(found.filter("session_idx = 1").collect(), key=lambda r: r.pos)
    assert [r.destination_port for r in one] == [2.0, 3.0, 4.0, 5.0, 6.0]


def test_cap_lists_and_missing_files(spark, folder):
    capped = load_directory(spark, str(folder), max_rows_per_file=10)
    assert {r.source_file: r["count"] for r in capped.groupBy("source_file").count().collect()} == {"a.csv": 3, "b.csv": 10}
    assert load_listed(spark, str(folder), ["b.csv", "gone.csv"]).count() == 50
    with pytest.raises(FileNotFoundError):
        load_listed(spark, str(folder), ["gone.csv"])
    with pytest.raises(FileNotFoundError):
        load_directory(spark, str(folder / "empty"))


def test_broken_files_are_left_out_whole_and_reported(spark, folder):
    (folder / "c.csv").write_bytes(b"")
    write_csv(folder / "d.csv", [({"Destination Port": 1}, "BENIGN"), ({"Destination Port": 2}, "BENIGN,one,more"), ({}, "BENIGN")])
    whole = gzip.compress("\n".join([",".join(HEADER + [" Label"])] + [line({"Idle Min": i}, "Bot") for i in range(9000)]).encode())
    (folder / "e.csv.gz").write_bytes(whole[:len(whole) // 2])
    paths = [str(folder / f"{n}") for n in ("a.csv", "b.csv", "c.csv", "d.csv", "e.csv.gz")]
    flows = load_flows(spark, paths)
    assert flows.count() == 53 and {r.source_file for r in flows.collect()} == {"a.csv", "b.csv"}
    said = {r["file"].rsplit("/", 1)[1]: (r["status"], r["rows"]) for r in csv_report(spark, paths).collect()}
    assert said["a.csv"] == ("ok", 3) and said["b.csv"] == ("ok", 50) and said["c.csv"] == ("no header", 0)
    assert said["d.csv"] == ("a line of 81 fields under a header of 79", 0)
    assert said["e.csv.gz"][0].startswith("unreadable") and said["e.csv.gz"][1] == 0
    (folder / "e.csv.gz").write_bytes(whole)
    assert load_flows(spark, paths).count() == 9053


def test_rows_keep_their_identity_and_the_sample_its_rows_under_any_layout(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    for name, n in (("a.csv", 400), ("b.csv", 3), ("c.csv", 150)):
        write_csv(folder / name, [({"Destination Port": i, "Idle Min": len(name)}, "ddos") for i in range(n)])
    with open(folder / "b.csv", "a") as file:
        file.write("\n\n" + line({"Destination Port": 77}, "Bot") + "\n")

    def read(size, **options):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = load_directory(spark, str(folder), **options)
            return {(r.flow_id >> 40, r.flow_id & (1 << 40) - 1, r.destination_port) for r in found.collect()}, found.rdd.getNumPartitions()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    (large, few), (small, many) = read("128m"), read("4k")
    assert many > few and large == small
    assert large == {(0, i + 1, float(i)) for i in range(400)} | {(1, i + 1, float(i)) for i in range(3)} | {(1, 6, 77.0)} | {
        (2, i + 1, float(i)) for i in range(150)}
    assert read("128m", max_rows_per_file=20)[0] == read("4k", max_rows_per_file=20)[0]


def test_files_with_other_columns_are_joined_by_name(spark, folder):
    write_csv(folder / "d.csv", [({"Destination Port": 7}, "Bot")], header=list(reversed(HEADER)))
    rows = load_flows(spark, [str(folder / "a.csv"), str(folder / "d.csv")]).filter("label_id = 1").collect()
    # The values of the reversed file stand in reversed columns.
    assert len(rows) == 1 and rows[0].idle_min == 7.0


def test_session_store(spark, tmp_path):
    flows = spark.createDataFrame([(1, "train"), (2, "test")], "flow_id long, split string")
    stats = flows.withColumnRenamed("flow_id", "stat_flow_count")
    stores.write_sessions(flows, stats, str(tmp_path / "s"), {"session_size": 20})
    got, got_stats, about = stores.read_sessions(spark, str(tmp_path / "s"), "test")
    assert got.first().flow_id == 2 and got_stats.count() == 1 and about == {"session_size": 20}


def test_flow_array_store(spark, tmp_path):
    flows = spark.createDataFrame([(1, 0, 2.0, "train"), (2, 1, 4.0, "train")], "flow_id long, label_id int, x double, split string")
    scaler = FeatureScaler.fit(flows, ["x"])
    stores.write_flow_arrays(flows, ["x"], scaler, str(tmp_path / "f"))
    rows = sorted(spark.read.parquet(str(tmp_path / "f")).collect(), key=lambda r: r.flow_id)
    assert [r.raw for r in rows] == [[2.0], [4.0]] and [r.scaled for r in rows] == [[-1.0], [1.0]]


def test_schema_file(spark, tmp_path):
    path = str(tmp_path / "schema")
    assert stores.verify_schema(spark, ["a"], path) == (True, [], [])
    stores.write_schema(spark, ["a", "b"], path)
    assert stores.verify_schema(spark, ["a", "b"], path) == (True, [], [])
    assert stores.verify_schema(spark, ["b", "c"], path) == (False, ["a"], ["c"])
    assert stores.verify_schema(spark, ["b", "a"], path) == (False, [], [])


def test_json_report(spark, tmp_path):
    stores.write_json(spark.range(3), str(tmp_path / "r"))
    assert stores.read_json(spark, str(tmp_path / "r")).count() == 3


def test_knowledge_index_is_reused_and_rebuilt(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = stores.knowledge_texts(spark)
    assert texts.count() == 15 and "SEVERITY: CRITICAL" in texts.filter("attack_id = 2").first().text
    index = stores.build_knowledge_index(spark, TextEmbedder.fit(texts, dims=64), path)
    assert index.count() == 15 and index.filter("id = 'attack_3'").first().attack_name == "DoS GoldenEye"
    marker = files.glob(spark, f"{path}/part-*")
    stores.build_knowledge_index(spark, TextEmbedder.fit(texts, dims=64), path)
    assert files.glob(spark, f"{path}/part-*") == marker
    wider = stores.build_knowledge_index(spark, TextEmbedder.fit(texts, dims=128), path)
    assert files.glob(spark, f"{path}/part-*") != marker and len(wider.first().embedding) == 128


REST = ("rest-001", 1700000000.0, 10, "PortScan", 0.92, True, 20)
STREAM = ("stream-001", 1700000001.0, 0, "BENIGN", 0.95, False, 20)
ALERT = "alert_uuid string, ts double, attack_id int, attack_name string, confidence double, is_attack boolean, n_flows int"


@pytest.fixture
def store(spark, tmp_path):
    return A.AlertTable(spark, str(tmp_path / "alerts"), max_alerts=5)


def test_alert_table(spark, store):
    assert store.batches() == [] and store.read().count() == 0
    store.record(spark.createDataFrame([REST], ALERT), "rest")
    store.record(spark.createDataFrame([STREAM], ALERT).withColumn("ground_truth", F.lit(1)), "stream")
    rows = {r.alert_uuid: r for r in store.numbered().collect()}
    assert rows["rest-001"].verdict is None and rows["stream-001"].verdict == "FN"
    assert (rows["rest-001"].seq, rows["stream-001"].seq) == (1, 2)
    assert '"attack_name":"PortScan"' in rows["rest-001"].raw
    store.record(spark.createDataFrame([REST], ALERT).withColumn("confidence", F.lit(0.5)), "rest")
    again = {r.alert_uuid: r for r in store.numbered().collect()}
    assert len(again) == 2 and again["rest-001"].confidence == 0.5
    assert (again["stream-001"].seq, again["rest-001"].seq) == (1, 2)
    assert [r.alert_uuid for r in recent_alerts(store.read(), 1).collect()] == ["rest-001"]
    store.clear()
    assert store.read().count() == 0 and store.batches() == []


def test_alert_retention_and_null_ids(spark, store):
    many = spark.range(9).select(F.lit(None).cast("string").alias("alert_uuid"), F.col("id").cast("double").alias("ts"))
    store.record(many, "rest")
    assert sorted(r.ts for r in store.read().collect()) == [4.0, 5.0, 6.0, 7.0, 8.0]
    store.record(many.limit(1).withColumn("ts", F.lit(99.0)), "rest")
    assert sorted(r.ts for r in store.read().collect())[-1] == 99.0 and store.read().count() == 5


def test_alert_table_without_a_limit_keeps_all(spark, tmp_path):
    store = A.AlertTable(spark, str(tmp_path / "all"))
    many = spark.range(10_050).select(
        F.col("id").cast("string").alias("alert_uuid"), (F.col("id") % 7).cast("double").alias("ts"))
    store.record(many.filter("id < 10040"), "rest")
    store.record(many.filter("id >= 10030"), "rest")
    rows = store.numbered().collect()
    assert sorted(r.seq for r in rows) == list(range(1, 10_051))
    first = sorted((r for r in rows if int(r.alert_uuid) < 10_030), key=lambda r: r.seq)
    assert first == sorted(first, key=lambda r: (r.ts, r.alert_uuid))
    assert sorted(r.seq for r in rows if int(r.alert_uuid) >= 10_030) == list(range(10_031, 10_051))


def test_repeated_batch_changes_nothing(spark, store):
    batch = spark.createDataFrame([REST, STREAM], ALERT)
    store.record(batch, "stream", batch_id=0)
    first = store.read().collect()
    store.record(batch, "stream", batch_id=0)
    assert store.read().collect() == first and len(store.batches()) == 1


def _ids(store):
    return sorted(r["alert_uuid"] for r in store.read().collect())


def test_a_batch_that_died_is_taken_when_it_comes_again(spark, tmp_path, monkeypatch):
    store = A.AlertTable(spark, str(tmp_path / "died"))
    batch = spark.createDataFrame([STREAM], ALERT)
    # the batch leaves a part file behind but no marker
    store.record(batch, "stream", batch_id=0, writer="a")
    os.remove(f"{store.batches()[0].removeprefix('file:')}/_SUCCESS")
    assert store.read().count() == 0
    store.record(spark.createDataFrame([REST], ALERT), "rest")
    assert _ids(store) == ["rest-001"]
    store.record(batch, "stream", batch_id=0, writer="a")
    assert _ids(store) == ["rest-001", "stream-001"]


def test_writers_that_start_from_the_same_state_keep_each_others_alerts(spark, tmp_path):
    root = str(tmp_path / "two")
    one, two = A.AlertTable(spark, root), A.AlertTable(spark, root)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda job: job[0].record(spark.createDataFrame([job[1]], ALERT), "rest"), [(one, REST), (two, STREAM)]))
    assert _ids(one) == _ids(two) == ["rest-001", "stream-001"]


def test_compaction_keeps_rows_and_known_batches(spark, tmp_path):
    store = A.AlertTable(spark, str(tmp_path / "compact"))
    nameless = spark.createDataFrame([(None, 5.0), (None, 5.0)], "alert_uuid string, ts double")
    store.record(spark.createDataFrame([REST, STREAM], ALERT), "stream", batch_id=0)
    store.record(spark.createDataFrame([REST], ALERT).withColumn("confidence", F.lit(0.1)), "rest")
    store.record(nameless, "rest")
    before = sorted(map(str, store.read().collect()))
    assert len(before) == 4 and store.log().count() == 5
    rows_twice = store.read()
    rows_twice.write.parquet(store._folder("died after writing", 0))
    assert sorted(map(str, store.read().collect())) == before
    store.compact()
    assert sorted(map(str, store.read().collect())) == before and store.log().count() == 4
    store.record(spark.createDataFrame([REST, STREAM], ALERT), "stream", batch_id=0)
    assert sorted(map(str, store.read().collect())) == before


def test_write_failure_is_not_fatal(spark, tmp_path):
    (tmp_path / "blocked").write_text("a file where the folder should be")
    store = A.AlertTable(spark, str(tmp_path / "blocked"))
    assert store.record_safely(spark.createDataFrame([REST], ALERT)) is False


def test_bulky_part_is_not_stored(spark, store):
    store.record(spark.createDataFrame([REST], ALERT).withColumn("threat_intelligence", F.lit("long")), "rest")
    assert "threat_intelligence" not in store.read().first().raw


def test_alert_table_keeps_what_streams_and_requests_share(spark, tmp_path):
    store = A.AlertTable(spark, str(tmp_path / "shared"))

    def one(name, ts):
        return spark.createDataFrame([REST], ALERT).withColumn("alert_uuid", F.lit(name)).withColumn("ts", F.lit(float(ts)))

    def ids():
        return sorted(r["alert_uuid"] for r in store.read().collect())

    store.record(one("r1", 1), "rest")
    store.record(one("r2", 2), "rest")
    store.record(one("s0", 3), "stream", batch_id=0, writer="a")
    assert ids() == ["r1", "r2", "s0"]
    store.record(one("r3", 4), "rest")
    store.record(one("s1", 5), "stream", batch_id=1, writer="a")
    store.record(one("s1", 5), "stream", batch_id=1, writer="a")
    store.record(one("t1", 6), "stream", batch_id=1, writer="b")
    assert ids() == ["r1", "r2", "r3", "s0", "s1", "t1"]
    store.clear()
    store.record(one("s2", 7), "stream", batch_id=2, writer="a")
    assert ids() == ["s2"]
