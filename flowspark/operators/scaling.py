"""Standard scaling and class weights."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.literals import literal_map, sql_text
from flowspark.operators.sampling import class_totals


class FeatureScaler:
    """Per-column mean and population deviation; a constant column is divided by 1."""

    def __init__(self, means, deviations):
        self.means = dict(means)
        self.deviations = dict(deviations)

    @classmethod
    def fit(cls, df: DataFrame, columns):
        aggs = []
        for i, c in enumerate(columns):
            value = f"CAST(`{c}` AS DOUBLE)"
            aggs += [F.expr(f"avg({value})").alias(f"m{i}"), F.expr(f"stddev_pop({value})").alias(f"s{i}")]
        row = df.agg(*aggs).first()
        means, deviations = {}, {}
        for i, c in enumerate(columns):
            mean, sd = row[f"m{i}"], row[f"s{i}"]
            if mean is None:
                raise ValueError("cannot fit a scaler on an empty table")
            # A deviation that is only rounding noise counts as constant.
            means[c], deviations[c] = mean, (sd if sd > 1e-12 * max(1.0, abs(mean)) else 1.0)
        return cls(means, deviations)

    @property
    def columns(self):
        return list(self.means)

    def scaled_sql(self, name):
        return f"(CAST(`{name}` AS DOUBLE) - {sql_text(self.means[name])}) / {sql_text(self.deviations[name])}"

    def scaled(self, name):
        return F.expr(self.scaled_sql(name))

    def transform(self, df: DataFrame, suffix=""):
        return df.withColumns({c + suffix: self.scaled(c) for c in self.columns})

    def save(self, spark, path):
        rows = [(i, c, self.means[c], self.deviations[c]) for i, c in enumerate(self.columns)]
        spark.createDataFrame(rows, "position int, name string, mean double, deviation double") \
            .coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark, path):
        rows = spark.read.schema("position int, name string, mean double, deviation double").json(path)
        rows = sorted(rows.collect(), key=lambda r: r["position"])
        return cls({r["name"]: r["mean"] for r in rows}, {r["name"]: r["deviation"] for r in rows})


def log_class_weights(df: DataFrame, label="label_id", name="weight"):
    """Row weights ln(N / class rows) + 1, scaled so that they add up to N."""
    totals = class_totals(df, label)
    n = sum(totals.values())
    raw = {c: math.log(n / k) + 1.0 for c, k in totals.items()}
    scale = n / sum(raw[c] * totals[c] for c in totals) if n else 1.0
    return _with_weights(df, {c: w * scale for c, w in raw.items()}, label, name)


def inverse_class_weights(df: DataFrame, label="label_id", name="weight"):
    """Row weights 1 / class rows, scaled to average 1 over the classes present."""
    totals = class_totals(df, label)
    inverse = {c: 1.0 / k for c, k in totals.items()}
    scale = len(inverse) / sum(inverse.values()) if inverse else 1.0
    return _with_weights(df, {c: w * scale for c, w in inverse.items()}, label, name)


def _with_weights(df, weights, label, name):
    if not weights:
        return df.withColumn(name, F.lit(1.0))
    return df.withColumn(name, F.try_element_at(literal_map(weights), F.col(label)))
