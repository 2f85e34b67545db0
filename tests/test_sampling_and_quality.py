import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import quality as Q
from flowspark.operators.sampling import (
    balanced_resample, capped_sample, class_pool, first_exemplars, mask_fields, stratified_split,
)
from flowspark.operators.scaling import FeatureScaler, inverse_class_weights, log_class_weights


def rows(spark, n=5000):
    return spark.range(n).select(
        F.col("id").alias("flow_id"),
        F.when(F.col("id") % 100 == 0, 2).when(F.col("id") % 1000 == 1, 4).otherwise(0).alias("label_id"),
    )


@pytest.mark.parametrize("n", [1, 7, 40, 100000])
def test_cap_is_exact_and_repeatable(spark, n):
    df = rows(spark)
    got = capped_sample(df, n, ["label_id"], "flow_id")
    sizes = {r.label_id: r["count"] for r in df.groupBy("label_id").count().collect()}
    kept = {r.label_id: r["count"] for r in got.groupBy("label_id").count().collect()}
    assert kept == {c: min(n, k) for c, k in sizes.items()}
    again = capped_sample(df.repartition(3), n, ["label_id"], "flow_id")
    assert got.exceptAll(again).count() == 0 and again.count() == got.count()


def test_cap_with_repeated_ids_and_null_groups(spark):
    copies = spark.range(20000).select(F.lit(5).alias("flow_id"), F.lit(None).cast("int").alias("label_id"))
    assert capped_sample(copies, 3, ["label_id"], "flow_id").count() == 3


def test_rows_stay_where_they_are_for_a_few_groups(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "100KB")
    try:
        plan = capped_sample(rows(spark, 100_000), 7, ["label_id"], "flow_id")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pool_merges_spellings(spark):
    df = rows(spark).withColumn("label", F.when(F.col("flow_id") % 2 == 0, "DDoS").otherwise(" ddos"))
    pool = class_pool(df, 25)
    assert pool.count() == 25 and pool.select("class_name").distinct().first()[0] == "DDoS"


def test_exemplars_come_from_the_first_file_with_enough(spark):
    data = [("a", 1, i) for i in range(3)] + [("b", 1, 10 + i) for i in range(6)] + [("c", 1, 30 + i) for i in range(9)]
    df = spark.createDataFrame(data, "source_file string, label_id int, flow_id long")
    got = first_exemplars(df, 5)
    assert sorted(r.flow_id for r in got.collect()) == [10, 11, 12, 13, 14]
    assert first_exemplars(df, 5, targets=[2]).count() == 0 and first_exemplars(df, 20).count() == 0


def test_split_shares(spark):
    df = rows(spark)
    got = {}
    for r in stratified_split(df, hot_rows=100).groupBy("label_id", "split").count().collect():
        got.setdefault(r.label_id, {})[r.split] = r["count"]
    for c, n in {r.label_id: r["count"] for r in df.groupBy("label_id").count().collect()}.items():
        rest = -(-n * 30 // 100)
        assert sum(got[c].values()) == n and got[c]["train"] == n - rest
        assert abs(got[c].get("val", 0) - got[c].get("test", 0)) <= 1


def test_split_with_a_single_row_class(spark):
    df = rows(spark, 99).withColumn("label_id", F.when(F.col("flow_id") == 5, 9).otherwise(0))
    counts = {r.split: r["count"] for r in stratified_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 69, "val": 15, "test": 15}


def test_resample_balances_classes(spark):
    df = rows(spark, 20000)
    drawn = balanced_resample(df)
    counts = {r.label_id: r["count"] for r in drawn.groupBy("label_id").count().collect()}
    assert sum(counts.values()) == 20000
    for n in counts.values():
        assert n == pytest.approx(20000 / 3, rel=0.05)
    again = balanced_resample(df.repartition(7), hot_rows=100)
    assert again.exceptAll(drawn).count() == 0 and again.count() == 20000
    assert balanced_resample(df, size=777, seed=5).count() == 777
    assert drawn.groupBy("flow_id", "copy").count().filter("count > 1").count() == 0


def test_resample_of_a_very_rare_class(spark):
    df = rows(spark, 20000).withColumn("label_id", F.when(F.col("flow_id") == 7, 3).otherwise(0))
    drawn = balanced_resample(df, chunk=100)
    rare = drawn.filter("label_id = 3")
    assert rare.count() == pytest.approx(10000, rel=0.03) and drawn.count() == 20000
    assert sorted(r["copy"] for r in rare.collect()) == list(range(rare.count()))
    holed = df.withColumn("label_id", F.when(F.col("label_id") == 3, 3))
    assert balanced_resample(holed, chunk=100).filter("label_id IS NULL").count() == pytest.approx(10000, rel=0.03)
    assert balanced_resample(df.limit(0)).count() == 0


def test_masking_rate_and_targets(spark):
    flows = spark.range(4000).select(F.lit(1).alias("host"), F.lit(0).alias("session_idx"), F.col("id").alias("pos"),
                                     F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    found = mask_fields(flows, ["x", "y"])
    row = found.agg(F.avg(F.col("masked").cast("int")).alias("rate"), F.count("*").alias("n")).first()
    assert row.n == 8000 and row.rate == pytest.approx(0.15, abs=0.015)
    assert found.filter("masked AND (value <> 0 OR target IS NULL)").count() == 0
    assert found.filter("NOT masked AND (value = 0 OR target IS NOT NULL)").count() == 0


def test_scaler(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = rng.normal(5, 3, (200, 2))
    df = spark.createDataFrame([(float(a), float(b), 7.0) for a, b in data], "a double, b double, c double")
    scaler = FeatureScaler.fit(df, ["a", "b", "c"])
    got = np.array([tuple(r) for r in scaler.transform(df).collect()])
    want = (data - data.mean(axis=0)) / data.std(axis=0)
    assert np.allclose(got[:, :2], want) and (got[:, 2] == 0).all()
    scaler.save(spark, str(tmp_path / "scaler"))
    loaded = FeatureScaler.load(spark, str(tmp_path / "scaler"))
    assert loaded.columns == scaler.columns and loaded.means == scaler.means and loaded.deviations == scaler.deviations


def test_weights(spark):
    df = rows(spark)
    log = log_class_weights(df).agg(F.sum("weight").alias("s"), F.count("*").alias("n")).first()
    assert log.s == pytest.approx(log.n)
    inverse = inverse_class_weights(df).select("label_id", "weight").distinct().collect()
    assert np.mean([r.weight for r in inverse]) == pytest.approx(1.0)


def test_cell_and_schema_reports(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), "x"), (None, -float("inf"), "y")], "a double, b double, s string")
    cells = {r.column: (r.nan_count, r.inf_count) for r in Q.cell_report(df, ["a", "b"]).collect()}
    assert cells == {"a": (2, 0), "b": (0, 2)}
    found = {(r.finding, r.column) for r in Q.schema_report(df, ["a", "s", "z"]).collect()}
    assert found == {("missing", "z"), ("extra", "b"), ("not_numeric", "s"), ("label_missing", "label_id")}
    saved = spark.createDataFrame([("a",), ("q",)], "name string")
    diff = {(r.finding, r.name) for r in Q.name_differences(df, saved).collect()}
    assert diff == {("missing", "q"), ("extra", "b"), ("extra", "s")}


def test_label_reports(spark):
    df = rows(spark, 2000)
    balance = Q.label_balance(df, min_samples=5).first()
    assert balance.num_classes_present == 3 and balance.rare_classes == [4] and 0 not in balance.empty_classes
    assert balance.imbalance_ratio == 989.0 and balance.extreme_imbalance is False
    one = Q.label_balance(df.filter("label_id = 0")).first()
    assert one.imbalance_ratio is None and one.extreme_imbalance is False
    by_file = Q.label_distribution_by_file(df.withColumn("source_file", F.lit("f")))
    assert sum(r.percent for r in by_file.collect()) == pytest.approx(100)


def test_request_limits(spark):
    flows = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, None), (3, [1.0])] + [(4, [1.0])] * 5,
                                  "request_id int, features array<double>")
    ok, bad = Q.split_requests(flows, 4)
    assert sorted(r.request_id for r in ok.collect()) == [1, 3]
    assert {r.request_id: r.n_flows for r in bad.collect()} == {2: 0, 4: 5}
