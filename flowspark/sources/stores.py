"""Tables and files written between the stages."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.text import kb_text, schema_hash, with_prefix
from flowspark.knowledge import knowledge_base
from flowspark.operators.scaling import FeatureScaler
from flowspark.sources import files


def write_json(df: DataFrame, path):
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark, path):
    return spark.read.json(path)


def write_metadata(spark, path, metadata):
    """A dictionary as one line of JSON text."""
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark, path):
    return json.loads(spark.read.text(path).first()["value"])


def write_sessions(session_flows: DataFrame, stats: DataFrame, root, metadata):
    """Sessions (long form) and their statistics, both with a `split` column, plus metadata."""
    session_flows.write.mode("overwrite").partitionBy("split").parquet(f"{root}/sessions")
    stats.write.mode("overwrite").partitionBy("split").parquet(f"{root}/stats")
    write_metadata(session_flows.sparkSession, f"{root}/metadata", metadata)


def read_sessions(spark, root, split=None):
    """(session flows, stats, metadata); one split reads only its own folders."""
    flows, stats = spark.read.parquet(f"{root}/sessions"), spark.read.parquet(f"{root}/stats")
    if split is not None:
        flows, stats = flows.filter(F.col("split") == split), stats.filter(F.col("split") == split)
    return flows, stats, read_metadata(spark, f"{root}/metadata")


def write_flow_arrays(flows: DataFrame, features, scaler: FeatureScaler, path, extra=("flow_id", "label_id")):
    """Per-flow raw and scaled feature arrays by split."""
    flows.select(
        *extra, "split",
        F.array(*[F.col(c).cast("double") for c in features]).alias("raw"),
        F.array(*[scaler.scaled(c) for c in features]).alias("scaled"),
    ).write.mode("overwrite").partitionBy("split").parquet(path)


def write_schema(spark, names, path):
    """Feature names and their hash."""
    write_metadata(spark, path, {
        "feature_names": list(names), "schema_hash": hash_names(spark, names), "n_features": len(names),
    })


def hash_names(spark, names):
    return spark.range(1).select(schema_hash(F.array(*[F.lit(n) for n in names])).alias("h")).first()["h"]


def verify_schema(spark, names, path):
    """(matches, missing, extra) against a saved schema; a schema that was never saved matches."""
    if not files.exists(spark, path):
        return True, [], []
    saved = read_metadata(spark, path)
    if saved["schema_hash"] == hash_names(spark, names):
        return True, [], []
    before, now = saved["feature_names"], list(names)
    return False, [n for n in before if n not in now], [n for n in now if n not in before]


def knowledge_texts(spark) -> DataFrame:
    """Knowledge-base rows as (text, metadata columns) for embedding."""
    return knowledge_base(spark).select(kb_text().alias("text"), "attack_id", "attack_name", "category", "severity")


def build_knowledge_index(spark, embedder, path, force=False) -> DataFrame:
    """Embedded knowledge base, keyed attack_{id}; written anew when absent, forced or of other width."""
    if not force and files.exists(spark, path):
        saved = spark.read.parquet(path)
        row = saved.select(F.size("embedding").alias("dims")).first()
        if row is not None and row["dims"] == embedder.dims:
            return saved
    texts = knowledge_texts(spark).withColumn("document", F.col("text")).withColumn("text", with_prefix(F.col("text")))
    index = embedder.transform(texts, "text").select(
        F.concat(F.lit("attack_"), F.col("attack_id").cast("string")).alias("id"),
        "document", "attack_id", "attack_name", "category", "severity", "embedding",
    )
    index.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
