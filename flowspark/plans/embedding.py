"""Vectors for sessions and for texts."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_DIMS = 512


class TextEmbedder:
    """Hashed TF-IDF of lower-cased words, unit length. Reads whole texts."""

    def __init__(self, model: PipelineModel, dims):
        self.model, self.dims = model, dims

    @classmethod
    def fit(cls, texts: DataFrame, column="text", dims=TEXT_DIMS):
        stages = Pipeline(stages=[
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}.]+", minTokenLength=1),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit"),
        ])
        return cls(stages.fit(texts.select(F.coalesce(F.col(column), F.lit("")).alias("_text"))), dims)

    def transform(self, df: DataFrame, column="text", name="embedding", dims=None):
        """Add the vector as an array; dims keeps only the first entries."""
        out = self.model.transform(df.withColumn("_text", F.coalesce(F.col(column), F.lit(""))))
        vector = vector_to_array("_unit", "float32")
        if dims:
            vector = F.slice(vector, 1, dims)
        return out.withColumn(name, vector).drop("_text", "_words", "_tf", "_tfidf", "_unit")

    def save(self, path):
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path):
        model = PipelineModel.load(path)
        return cls(model, model.stages[1].getNumFeatures())


class SessionEmbedder:
    """Principal components of a session's scaled flow features, learned on benign sessions.

    A session is summarised by mean, population deviation and last-minus-first of each scaled
    feature, all in one aggregate.
    """

    def __init__(self, scaler, model: PipelineModel, keys=("host", "session_idx")):
        self.scaler, self.model, self.keys = scaler, model, list(keys)

    @staticmethod
    def aggregates(scaler):
        """The summary as aggregates, for use beside others of the same grouping."""
        aggs = []
        for i, c in enumerate(scaler.columns):
            z = scaler.scaled_sql(c)
            aggs += [
                F.expr(f"avg({z})").alias(f"e{i}_mean"), F.expr(f"stddev_pop({z})").alias(f"e{i}_sd"),
                F.expr(f"max_by({z}, pos) - min_by({z}, pos)").alias(f"e{i}_trend"),
            ]
        return aggs

    @classmethod
    def summarise(cls, session_flows: DataFrame, scaler, keys=("host", "session_idx"), extra_aggs=()):
        return session_flows.groupBy(*keys).agg(*cls.aggregates(scaler), *extra_aggs)

    @staticmethod
    def columns(scaler):
        return [f"e{i}_{part}" for i in range(len(scaler.columns)) for part in ("mean", "sd", "trend")]

    @classmethod
    def fit(cls, benign_sessions: DataFrame, scaler, k=16, keys=("host", "session_idx")):
        return cls.fit_summary(cls.summarise(benign_sessions, scaler, keys), scaler, k, keys)

    @classmethod
    def fit_summary(cls, benign_summary: DataFrame, scaler, k=16, keys=("host", "session_idx")):
        """fit from the summary of the benign sessions."""
        columns = cls.columns(scaler)
        model = Pipeline(stages=[
            VectorAssembler(inputCols=columns, outputCol="_summary", handleInvalid="keep"),
            PCA(k=min(k, len(columns)), inputCol="_summary", outputCol="embedding"),
        ]).fit(benign_summary)
        return cls(scaler, model, keys)

    def transform(self, session_flows: DataFrame, extra_aggs=()):
        """One row per session with its embedding vector."""
        return self.embed(self.summarise(session_flows, self.scaler, self.keys, extra_aggs))

    def embed(self, summary: DataFrame):
        """The embedding in place of the summary's columns."""
        return self.model.transform(summary).drop("_summary", *self.columns(self.scaler))
