"""Flow files as a stream of scored detection events."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.cleaning import clean_features, pad_features
from flowspark.functions.labels import encode_label, label_name
from flowspark.functions.scores import confidence
from flowspark.schema import FEATURES, N_CLASSES, RAW_LABEL, snake
from flowspark.sources.flow_csv import ENCODING

_CARRIED = ("flow_id", "host", "ts", "label_id", "file_order", "source_file", "score_error")


def stream_csv(spark, directory, columns, files_per_trigger=1):
    """Text columns of CSV files as they arrive; files_per_trigger bounds the work of a batch."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.readStream.schema(schema).option("header", True).option("encoding", ENCODING)
        .option("maxFilesPerTrigger", files_per_trigger).csv(directory)
        .select("*", F.col("_metadata.file_name").alias("source_file"))
    )


def stream_parquet(spark, directory, schema, files_per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def clean_stream(flows: DataFrame) -> DataFrame:
    """Coerce, clean and pad; label text becomes label_id. The same columns as the batch path."""
    label = snake(RAW_LABEL)
    if label in flows.columns and "label_id" not in flows.columns:
        flows = flows.withColumn("label_id", encode_label(F.col(label)))
    return pad_features(clean_features(flows), FEATURES, extra=[c for c in _CARRIED if c in flows.columns])


def detection_events(scored: DataFrame) -> DataFrame:
    """Event rows from (y_pred, probs) and, when known, label_id.

    A row without a score falls back to benign with P = 1 and is marked score_failed.
    """
    failed = F.col("probs").isNull() | F.col("y_pred").isNull()
    certain = F.array(F.lit(1.0), *[F.lit(0.0)] * (N_CLASSES - 1))
    class_id = F.when(failed, 0).otherwise(F.col("y_pred")).cast("int")
    probs = F.when(failed, certain).otherwise(F.col("probs"))
    carried = [c for c in _CARRIED if c in scored.columns and c != "label_id"]
    rows = scored.withColumn("attack_id", class_id).withColumn("probabilities", probs)
    return _with_truth(rows.withColumns({
        "attack_name": label_name(F.col("attack_id")),
        "confidence": confidence(F.col("probabilities"), F.col("attack_id")),
        "is_attack": F.col("attack_id") != 0,
        "score_failed": failed,
    }), carried)


def feature_events(flows: DataFrame) -> DataFrame:
    """Event rows of a pass without a model: class -1, no name, confidence 0."""
    carried = [c for c in _CARRIED if c in flows.columns and c != "label_id"]
    return _with_truth(flows.withColumns({
        "attack_id": F.lit(-1), "attack_name": F.lit(""), "confidence": F.lit(0.0),
        "probabilities": F.array().cast("array<double>"), "is_attack": F.lit(False), "score_failed": F.lit(False),
    }), carried, scored=False)


def _with_truth(rows, carried, scored=True):
    truth = F.col("label_id") if "label_id" in rows.columns else F.lit(None).cast("int")
    known = truth if scored else F.lit(None).cast("int")
    return rows.select(
        *carried, "attack_id", "attack_name", "confidence", "probabilities", "is_attack", "score_failed",
        truth.alias("ground_truth_id"), label_name(known).alias("ground_truth_name"),
        (F.col("attack_id") == known).alias("correct"),
    )


def apply_model_fn(flows: DataFrame, model_fn, scaler, id_column="flow_id", features=tuple(FEATURES)):
    """Score with a user's function(raw, scaled) -> (classes, probabilities), batch by batch.

    Both inputs are 2-d float arrays. A batch the function fails on gives null results, which
    detection_events turns into the benign fallback, and its reason in score_error. Other columns are kept.
    """
    raw = F.expr(f"array({', '.join(f'CAST(`{c}` AS DOUBLE)' for c in features)})")
    scaled = F.expr(f"array({', '.join(scaler.scaled_sql(c) for c in features)})")
    kept = [c for c in flows.columns if c not in features]
    schema = T.StructType([
        *[flows.schema[c] for c in kept],
        T.StructField("y_pred", T.IntegerType()), T.StructField("probs", T.ArrayType(T.DoubleType())),
        T.StructField("score_error", T.StringType()),
    ])

    def score(batches):
        for pdf in batches:
            out = pdf[kept].copy()
            try:
                classes, probs = model_fn(
                    np.stack(pdf["_raw"].to_numpy()), np.stack(pdf["_scaled"].to_numpy())
                )
                out["y_pred"] = pd.array(np.asarray(classes, dtype="int32"), dtype="Int32")
                out["probs"] = list(np.asarray(probs, dtype=float))
                out["score_error"] = None
            except Exception as error:
                out["y_pred"] = pd.array([None] * len(pdf), dtype="Int32")
                out["probs"] = None
                out["score_error"] = f"{type(error).__name__}: {error}"[:500]
            yield out

    return flows.select(*kept, raw.alias("_raw"), scaled.alias("_scaled")).mapInPandas(score, schema)


def score_stream(flows: DataFrame, model=None, model_fn=None, scaler=None):
    """Cleaned flows to events: a fitted ClassModel, a user function, or neither (features only)."""
    if model is not None:
        return detection_events(model.predict(flows))
    if model_fn is not None:
        return detection_events(apply_model_fn(flows, model_fn, scaler))
    return feature_events(flows)

