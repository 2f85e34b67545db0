import math

import pytest
from pyspark.sql import functions as F

from flowspark.errors import (
    DetectionError, EnrichmentError, FeatureDimensionError, InferenceError, ModelNotLoadedError, NaNInfError,
    SchemaError, SessionSizeError,
)
from flowspark.functions import alignment as A
from flowspark.functions import protocol as P
from flowspark.functions import scores as S
from flowspark.functions import text as X
from flowspark.functions.alerts import verdict
from flowspark.functions.cleaning import clean_features, clean_number, pad_features, prune, to_number
from flowspark.functions.labels import encode_label, label_name
from flowspark.schema import (
    EMBEDDING_DIM, FEATURES, HYBRID_DIM, LABELS, N_RAW_FEATURES, N_STATS, PROTOCOL_COLUMNS, RAW_FEATURES,
    STAT_NAMES, TRAINED_FEATURES, label_aliases,
)

INF, NAN = float("inf"), float("nan")


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_contract_sizes():
    assert len(RAW_FEATURES) == len(set(FEATURES)) == N_RAW_FEATURES == 78
    assert len(set(TRAINED_FEATURES)) == 81 == N_RAW_FEATURES - 1 + 4
    assert TRAINED_FEATURES[-4:] == PROTOCOL_COLUMNS and "subflow_bwd_packets" not in TRAINED_FEATURES
    assert N_STATS == len(set(STAT_NAMES)) == 26 and HYBRID_DIM == EMBEDDING_DIM + 26 == 282


@pytest.mark.parametrize("raw, expected", [
    ("BENIGN", 0), (" Bot\t", 1), ("DDoS", 2), ("Web Attack \x96 XSS", 14), ("Web Attack � Brute Force", 12),
    ("Web Attack – Sql Injection", 13), ("Web Attack  Brute Force", 12), ("Web Attack - XSS", 14),
    ("Web Attack ï¿½ XSS", 14), ("a dos hulk day", 4), ("BENIGN DDoS", 0), ("", 0), ("who knows", 0),
    ("Web Attack XSS", 14),
])
def test_label_spellings(spark, raw, expected):
    assert values(spark, [(raw,)], "t string", encode_label(F.col("t"))) == [(expected,)]


def test_strict_labels_do_not_know_the_plain_web_names(spark):
    assert values(spark, [("Web Attack XSS",)], "t string", encode_label(F.col("t"), strict=True)) == [(0,)]
    assert len(label_aliases(strict=True)) == 24


def test_label_names(spark):
    got = values(spark, [(0,), (14,), (99,), (-1,)], "i int", label_name(F.col("i")))
    assert got == [("BENIGN",), ("Web Attack XSS",), ("99",), ("-1",)]


@pytest.mark.parametrize("raw, zero, bound", [
    ("12.5", 12.5, 12.5), (" 7 ", 7.0, 7.0), ("1e3", 1000.0, 1000.0), ("Infinity", 0.0, 1e6), ("-Infinity", 0.0, -1e6),
    ("NaN", 0.0, 0.0), ("", 0.0, 0.0), ("abc", 0.0, 0.0), (None, 0.0, 0.0), ("1e12", 1e9, 1e9), ("-1e12", -1e9, -1e9),
    ("3d", 0.0, 0.0), ("0x10", 0.0, 0.0),
])
def test_cleaning(spark, raw, zero, bound):
    df = spark.createDataFrame([(raw,)], "t string").withColumn("x", to_number("t"))
    row = df.select(clean_number("x"), clean_number("x", "bound")).first()
    assert tuple(row) == (zero, bound)


def test_unknown_policy_is_refused():
    with pytest.raises(ValueError):
        clean_number("x", "other")


def test_clean_prune_pad(spark):
    df = spark.createDataFrame([("80", "x", 5)], "destination_port string, junk string, flow_id int")
    out = pad_features(clean_features(prune(df, extra=["flow_id"])), extra=["flow_id"])
    assert out.columns == ["flow_id", *FEATURES]
    row = out.first()
    assert row["destination_port"] == 80.0 and row["idle_min"] == 0.0


@pytest.mark.parametrize("port, size, expected", [
    (53.0, 5e6, 1), (80.0, 0.0, 2), (3000.0, 0.0, 2), (8443.0, 0.0, 3), (22.0, 0.0, 4), (9999.0, 1000001.0, 4),
    (9999.0, 1000000.0, 0), (None, 0.0, 0), (NAN, 0.0, 0), (53.9, 0.0, 1),
])
def test_log_type(spark, port, size, expected):
    assert values(spark, [(port, size)], "p double, b double", P.log_type("p", "b")) == [(expected,)]


@pytest.mark.parametrize("syn, fin, rst, fwd, bwd, code, token", [
    (1, 1, 1, 1, 1, 2, "RSTO"), (1, 1, 0, 1, 1, 0, "SF"), (1, 1, 0, 1, 0, 1, "SF"), (1, 0, 0, 1, 0, 1, "S0"),
    (0, 0, 0, 1, 1, 3, "SF"), (0, 0, 0, 1, 0, 3, "OTH"), (None, None, None, 1, 0, 3, "OTH"),
])
def test_connection_state(spark, syn, fin, rst, fwd, bwd, code, token):
    row = values(
        spark, [(syn, fin, rst, fwd, bwd)], "s int, f int, r int, fw int, bw int",
        P.conn_state("s", "f", "r", "bw"), P.conn_state_token("s", "f", "r", "fw", "bw"),
    )
    assert row == [(code, token)]


def test_service_and_protocol(spark):
    got = values(spark, [(53,), (80,), (443,), (21,), (22,), (25,), (143,), (8080,)], "p int", P.service_code("p"))
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6, 7, 0]
    assert values(spark, [(0, 1), (0, 0)], "f int, s int", P.proto_flag("f", "s"), P.proto_name("f", "s")) == [
        (1, "tcp"), (0, "udp")]


def test_enrichment_without_inputs(spark):
    row = P.add_protocol_columns(spark.createDataFrame([(1,)], "x int")).first()
    assert [row[c] for c in PROTOCOL_COLUMNS] == [0, 0, 3, 0]


def wide(spark, **given):
    row = [float(given.get(c, 1.0)) for c in FEATURES]
    return spark.createDataFrame([(*row, 3)], ", ".join(f"{c} double" for c in FEATURES) + ", log_type int")


def test_realign_drops_one_column_and_keeps_the_log_type(spark):
    out = A.realign(wide(spark, subflow_bwd_packets=99999, subflow_fwd_bytes=77777))
    assert out.columns == TRAINED_FEATURES
    row = out.first()
    assert 99999.0 not in row and row[63] == 77777.0 and row[77] == 3.0


def test_array_form_equals_column_form(spark):
    df = wide(spark, destination_port=443, syn_flag_count=0, fin_flag_count=0, rst_flag_count=0)
    arrays = df.select(F.array(*FEATURES).alias("f"), "log_type")
    assert list(A.realign(df).first()) == arrays.select(A.realign_array("f", "log_type")).first()[0]
    short = arrays.select(F.slice("f", 1, 50).alias("f"), "log_type")
    with pytest.raises(Exception, match="78 feature columns expected, 50 found"):
        short.select(A.realign_array("f", "log_type")).collect()


def test_typed_errors(spark):
    with pytest.raises(FeatureDimensionError) as width:
        A.check_width(spark.createDataFrame([(1.0,)], "destination_port double"), stage="input")
    assert (width.value.expected, width.value.actual) == (78, 1)
    bad = spark.createDataFrame([(NAN, 1.0), (INF, -INF), (1.0, 1.0)], "a double, b double")
    with pytest.raises(NaNInfError) as cells:
        A.check_finite(bad, ["a", "b"])
    assert cells.value.n_bad == 3
    assert A.check_finite(bad.filter("b = 1 AND NOT isnan(a)"), ["a", "b"]) is not None
    with pytest.raises(SessionSizeError) as size:
        A.check_session_sizes(spark.createDataFrame([(20,), (7,)], "n_flows int"))
    assert (size.value.expected, size.value.actual) == (20, 7)


def test_error_hierarchy():
    for kind in (FeatureDimensionError, SessionSizeError, NaNInfError):
        assert issubclass(kind, SchemaError)
    for kind in (SchemaError, ModelNotLoadedError, InferenceError, EnrichmentError):
        assert issubclass(kind, DetectionError) and issubclass(kind, RuntimeError)
    assert "C" in str(InferenceError("C", ValueError("x"))) and EnrichmentError("kb", "down").fatal is False


def test_score_functions(spark):
    p = [0.1, 0.4, 0.4, 0.1]
    df = spark.createDataFrame([(p, 1)], "p array<double>, c int")
    row = df.select(
        S.argmax_class(F.col("p")).alias("top"), S.confidence(F.col("p"), F.lit(9)).alias("outside"),
        S.confidence(F.col("p"), F.col("c")).alias("inside"), S.gated_class(F.col("p"), F.col("c"), 0.95).alias("gated"),
        S.gated_confidence(F.col("p"), F.col("c"), 0.95).alias("gated_conf"), S.softmax(F.col("p")).alias("soft"),
        S.top_predictions(F.col("p"), 3).alias("best"), S.scatter_classes(F.col("p"), [0, 2, 4, 10]).alias("wide"),
    ).first()
    assert (row.top, row.outside, row.inside, row.gated, row.gated_conf) == (1, 0.0, 0.4, 0, 0.1)
    total = sum(math.exp(x) for x in p)
    assert row.soft == pytest.approx([math.exp(x) / total for x in p])
    assert [b.attack_id for b in row.best] == [1, 2, 0]
    assert row.wide[10] == 0.1 and row.wide[1] == 0.0 and len(row.wide) == 15


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(S.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 1.0])


@pytest.mark.parametrize("call, truth, expected", [
    (True, 3, "TP"), (True, 0, "FP"), (False, 3, "FN"), (False, 0, "TN"), (True, None, None),
])
def test_verdict(spark, call, truth, expected):
    assert values(spark, [(call, truth)], "c boolean, t int", verdict(F.col("c"), F.col("t"))) == [(expected,)]


GOOD = '{"fp_likelihood":"LOW","fp_reasoning":"r","threat_summary":"s","investigation_steps":["a"],"severity_context":"c"}'


@pytest.mark.parametrize("raw, valid, missing", [
    (GOOD, True, []), (f"```json\n{GOOD}\n```", True, []), (f"  ```\n{GOOD}\n```  ", True, []), (f"```json\n{GOOD}", True, []),
    ('{"threat_summary":"s"}', True, ["fp_likelihood", "fp_reasoning", "investigation_steps", "severity_context"]),
    ("no json", False, None), ('{"broken": ', False, None), ("", False, None), (None, False, None),
])
def test_reply_parsing(spark, raw, valid, missing):
    row = spark.createDataFrame([(raw,)], "t string").select(X.parse_reply(F.col("t")).alias("r")).first().r
    assert row.valid == valid and row.missing_keys == missing
    if valid and not missing:
        assert row.investigation_steps == ["a"] and row.threat_summary == "s"


def test_schema_hash(spark):
    import hashlib
    names = ["a", "b c"]
    got = spark.createDataFrame([(names,)], "n array<string>").select(X.schema_hash(F.col("n"))).first()[0]
    assert got == hashlib.sha256("a|b c".encode()).hexdigest()[:16]


def test_technique_root_and_bands(spark):
    got = values(spark, [("T1499.002 - Flood",), ("T1110",)], "t string", X.technique_root(F.col("t")))
    assert [g[0] for g in got] == ["T1499", "T1110"]
    got = values(spark, [(0.95,), (0.9,), (0.7,), (0.1,)], "v double", X.kpi_band(F.col("v")))
    assert [g[0] for g in got] == ["green", "green", "yellow", "red"]


def test_labels_have_one_name_each():
    assert sorted(LABELS) == list(range(15)) and len(set(LABELS.values())) == 15
