"""Tree classifiers on session statistics (A), session embeddings (B) or both (C)."""

import math
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSizeHint, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.errors import FeatureDimensionError, InferenceError, ModelNotLoadedError
from flowspark.functions.literals import literal_map
from flowspark.functions.scores import argmax_class, confidence, scatter_classes
from flowspark.operators.sampling import class_totals
from flowspark.operators.scaling import log_class_weights
from flowspark.schema import N_CLASSES, STAT_NAMES, TRAINED_FEATURES
from flowspark.session import free_memory, materialise
from flowspark.sources import files
from flowspark.sources.stores import read_metadata, write_metadata

TREES = {"numTrees": 60, "maxDepth": 8, "subsamplingRate": 0.8, "seed": 42}
CONFIG_INPUTS = {"A": list(STAT_NAMES), "B": ["embedding"], "C": ["embedding", *STAT_NAMES]}


class ClassModel:
    """A fitted tree model over named columns, with the class ids it was trained on."""

    def __init__(self, stages: PipelineModel, inputs, classes, width):
        self.stages, self.inputs, self.classes, self.width = stages, list(inputs), list(classes), width

    @property
    def trees(self):
        return self.stages.stages[-1]

    @classmethod
    def fit(cls, rows: DataFrame, inputs, label="label", weight=None, **trees):
        """Train on rows with numeric or vector input columns; weight names a column of row weights."""
        classes = sorted(class_totals(rows, label))
        index = literal_map({c: float(i) for i, c in enumerate(classes)})
        train = rows.withColumn("_y", F.try_element_at(index, F.col(label)))
        assembler = VectorAssembler(inputCols=list(inputs), outputCol="_x", handleInvalid="keep")
        options = {**TREES, **trees}
        forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", probabilityCol="_p",
                                        rawPredictionCol="_raw", predictionCol="_pred", **options)
        if weight:
            forest = forest.setWeightCol(weight)
        if len(classes) < 2:
            raise ValueError("training needs at least two classes")
        stages = PipelineModel([*_size_hints(rows, inputs), assembler])
        model = forest.fit(stages.transform(train))
        return cls(PipelineModel([*stages.stages, model]), inputs, classes, model.numFeatures)

    def feature_names(self, embedding_dims=0):
        """Names of the assembled inputs; a vector column gives emb_0, emb_1, ..."""
        names = []
        for c in self.inputs:
            names += [f"emb_{i}" for i in range(embedding_dims)] if c == "embedding" else [c]
        return names

    def predict(self, rows: DataFrame):
        """Add probs (15 slots) and y_pred; the first class with the highest probability wins."""
        missing = [c for c in self.inputs if c not in rows.columns]
        if missing:
            raise FeatureDimensionError("model-input", len(self.inputs), len(self.inputs) - len(missing))
        scored = self.stages.transform(rows)
        probs = scatter_classes(vector_to_array("_p"), self.classes, N_CLASSES)
        return scored.withColumn("probs", probs).withColumn("y_pred", argmax_class(F.col("probs"))).drop(
            "_x", "_raw", "_p", "_pred"
        )

    def score_index(self, rows: DataFrame):
        """Add `prediction` and `probability` as used by the explanation operators."""
        scored = self.predict(rows)
        return scored.withColumn("probability", F.col("probs")).withColumn("prediction", F.col("y_pred"))

    def save(self, spark, path):
        self.stages.write().overwrite().save(f"{path}/stages")
        write_metadata(spark, f"{path}/about", {
            "inputs": self.inputs, "classes": self.classes, "width": self.width,
        })

    @classmethod
    def load(cls, spark, path):
        about = read_metadata(spark, f"{path}/about")
        return cls(PipelineModel.load(f"{path}/stages"), about["inputs"], about["classes"], about["width"])


def _size_hints(rows: DataFrame, inputs):
    """Width of each vector input, which the assembler needs to fill in a missing vector."""
    vectors = [c for c in inputs if isinstance(rows.schema[c].dataType, VectorUDT)]
    if not vectors:
        return []
    first = rows.select(*vectors).dropna().first()
    return [VectorSizeHint(inputCol=c, size=first[c].size, handleInvalid="optimistic") for c in vectors]


def _varying(rows: DataFrame, vector, width):
    """The places of a vector column of finite numbers that hold more than one value, as no tree can split on the others;
    all places if none has."""
    found = rows.agg(Summarizer.metrics("min", "max", "mean").summary(F.col(vector)).alias("s")).select("s.*").first()
    ends = zip(range(width), found["min"].toArray(), found["max"].toArray(), found["mean"].toArray())
    return [i for i, low, high, mean in ends if low != high or not math.isfinite(mean)] or list(range(width))


def unseen_classes(train: DataFrame, validation: DataFrame, label="label"):
    """Classes of the validation rows that training never saw."""
    return validation.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")


#: Boosting of the per-flow detector; it stops early when the validation rows gain less than the tolerance.
BOOSTING = {"maxIter": 40, "maxDepth": 5, "stepSize": 0.3, "subsamplingRate": 0.8, "validationTol": 0.01, "seed": 42}
#: Memory of a training row in the copy that a class keeps, without the 4 bytes a column: objects, errors, draws.
COPY_BYTES = 240
#: The fit adds doubles in the order of its columns and bins, which shows in the last digits of a probability.
_DIGITS = 1e12


class FlowClassifier:
    """Boosted trees on the columns of a single flow, one ensemble for each class against the others."""

    def __init__(self, stages, inputs, classes):
        self.stages, self.inputs, self.classes = list(stages), list(inputs), list(classes)

    @classmethod
    def fit(cls, flows: DataFrame, inputs=tuple(TRAINED_FEATURES), label="label_id", validation="validation", parallel=4, **boosting):
        """Train on flows with a boolean column that marks the validation rows; rare classes weigh more.

        Every class keeps a copy of the rows while it is fitted: at most `parallel` classes are fitted side by side, fewer
        where memory does not hold their copies, as each of the many passes would read the rest back from disk.
        """
        weighted = log_class_weights(flows, label, "_w")
        columns = [F.col(c).cast("double").alias(c) for c in inputs]
        every = VectorAssembler(inputCols=list(inputs), outputCol="_all", handleInvalid="keep")
        rows = every.transform(weighted.select(*columns, F.col(label).alias("_label"), "_w", F.col(validation).alias("_held")))
        # every class and iteration passes over these rows
        rows = materialise(rows.select("_all", "_label", "_w", "_held"), "flow-classifier")
        known = rows.filter("NOT _held AND _label IS NOT NULL").groupBy("_label").agg(F.count(F.lit(1)).alias("n"))
        known = {r["_label"]: r["n"] for r in known.limit(N_CLASSES + 1).collect()}
        classes = sorted(known)
        if not 2 <= len(classes) <= N_CLASSES:
            raise ValueError(f"training needs 2 to {N_CLASSES} classes")
        # every node of every tree counts all columns it is given
        places = _varying(rows, "_all", len(inputs))
        assembler = VectorAssembler(inputCols=[inputs[i] for i in places], outputCol="_x", handleInvalid="keep")
        rows = VectorSlicer(inputCol="_all", outputCol="_x", indices=places).transform(rows).drop("_all")

        def one(c):
            trees = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", validationIndicatorCol="_held",
                                  predictionCol=f"_is{c}", **{**BOOSTING, **boosting})
            trees = trees.setProbabilityCol(f"_p{c}").setRawPredictionCol(f"_raw{c}")
            return trees.fit(rows.filter("_label IS NOT NULL").withColumn("_y", (F.col("_label") == c).cast("double")))

        copies = free_memory(rows.sparkSession) // (sum(known.values()) * (4 * len(places) + COPY_BYTES))
        with ThreadPool(max(1, min(parallel, copies))) as pool:
            found = pool.map(one, classes)
        return cls([assembler, *found], inputs, classes)

    def predict(self, flows: DataFrame):
        """Add probs (15 slots, the ensembles' probabilities made to sum to 1, 12 digits) and y_pred; a stream may be given."""
        missing = [c for c in self.inputs if c not in flows.columns]
        if missing:
            raise FeatureDimensionError("flow-classifier", len(self.inputs), len(self.inputs) - len(missing))
        scored = flows
        for stage in self.stages:
            scored = stage.transform(scored)
        each = F.array(*[F.get(vector_to_array(f"_p{c}"), F.lit(1)) for c in self.classes])
        total = F.aggregate("_each", F.lit(0.0), lambda a, p: a + p)
        scored = scored.select(*flows.columns, each.alias("_each"))
        share = F.transform("_each", lambda p: F.when(total > 0, p / total).otherwise(F.lit(1.0 / len(self.classes))))
        share = F.transform(share, lambda p: F.rint(p * _DIGITS) / _DIGITS)
        probs = scatter_classes(share, self.classes, N_CLASSES)
        return scored.withColumn("probs", probs).drop("_each").withColumn("y_pred", argmax_class(F.col("probs")))

    def rounds(self):
        """Trees that each class kept."""
        return {c: stage.getNumTrees for c, stage in zip(self.classes, self.stages[1:])}

    def save(self, spark, path):
        PipelineModel(self.stages).write().overwrite().save(f"{path}/stages")
        write_metadata(spark, f"{path}/about", {"inputs": self.inputs, "classes": self.classes})

    @classmethod
    def load(cls, spark, path):
        about = read_metadata(spark, f"{path}/about")
        return cls(PipelineModel.load(f"{path}/stages").stages, about["inputs"], about["classes"])


class DetectorSet:
    """The models of configurations A, B and C; any of them may be absent."""

    def __init__(self, models=None):
        self.models = dict(models or {})

    @classmethod
    def fit(cls, sessions: DataFrame, label="label", configs=("A", "B", "C"), **trees):
        """Train the configurations on rows with statistics and embedding, weighted by class rarity."""
        weighted = log_class_weights(sessions, label, "_w")
        return cls({
            c: ClassModel.fit(weighted, CONFIG_INPUTS[c], label, "_w", **trees) for c in configs
        })

    def predict(self, sessions: DataFrame, config="C"):
        if config not in self.models:
            raise ModelNotLoadedError(f"config {config} model")
        try:
            return self.models[config].predict(sessions).withColumn("config", F.lit(config))
        except (AnalysisException, IllegalArgumentException) as error:
            # the inputs are there but are not what the model takes
            raise InferenceError(config, error) from error

    def predict_with_fallback(self, sessions: DataFrame):
        """C, else B, never A; config_used names the one that scored the row.

        Without either model the call fails before any job. A row C cannot score (a null or NaN
        input) is given to B; a row neither can score gets null results.
        """
        chain = [c for c in ("C", "B") if c in self.models]
        if not chain:
            raise ModelNotLoadedError("config C and config B models")
        scored = sessions
        for c in chain:
            usable = F.lit(True)
            for name in self.models[c].inputs:
                column = F.col(name)
                usable = usable & column.isNotNull()
                if name != "embedding":
                    usable = usable & ~F.isnan(column.cast("double"))
            scored = self.models[c].predict(scored.withColumn(f"_ok_{c}", usable))
            scored = scored.withColumnRenamed("probs", f"_probs_{c}").drop("y_pred")
        used = F
        for c in chain:
            used = used.when(F.col(f"_ok_{c}"), c)
        probs = F
        for c in chain:
            probs = probs.when(F.col(f"_ok_{c}"), F.col(f"_probs_{c}"))
        out = scored.withColumn("config_used", used).withColumn("probs", probs)
        out = out.drop(*[f"_ok_{c}" for c in chain], *[f"_probs_{c}" for c in chain])
        return out.withColumn("y_pred", argmax_class(F.col("probs"))).withColumn(
            "confidence", confidence(F.col("probs"), F.col("y_pred"))
        )

    def save(self, spark, root):
        for c, model in self.models.items():
            model.save(spark, f"{root}/config_{c.lower()}")

    @classmethod
    def load(cls, spark, root):
        found = {}
        for c in CONFIG_INPUTS:
            path = f"{root}/config_{c.lower()}"
            if files.exists(spark, path):
                found[c] = ClassModel.load(spark, path)
        return cls(found)

