"""Detections joined to the threat knowledge base, and how well that base covers the truth."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.alerts import intel_from_kb
from flowspark.functions.labels import label_name
from flowspark.functions.text import technique_root
from flowspark.knowledge import knowledge_base, technique_truth
from flowspark.operators.metrics import class_counts_from, confusion_counts

KB_LISTS = ["techniques", "zeek_indicators", "network_iocs", "response_actions", "mitre_tactics", "tags"]


def join_knowledge_base(detections: DataFrame, class_id="attack_id"):
    """Left join on the class; an unknown class keeps its row with severity UNKNOWN and empty lists."""
    kb = knowledge_base(detections.sparkSession).withColumnRenamed("attack_id", "_kb_id")
    taken = [c for c in kb.columns if c in detections.columns and c != "_kb_id"]
    # The knowledge base has one row per class, 15 in all.
    joined = detections.join(F.broadcast(kb.drop(*taken)), F.col(class_id) == F.col("_kb_id"), "left").drop("_kb_id")
    empty = F.array().cast("array<string>")
    filled = {c: F.coalesce(F.col(c), empty) for c in KB_LISTS if c not in taken}
    filled["severity"] = F.coalesce("severity", F.lit("UNKNOWN"))
    filled["description"] = F.coalesce("description", F.lit(""))
    if "attack_name" not in taken:
        filled["attack_name"] = F.coalesce(
            "attack_name", F.concat(F.lit("Unknown ("), F.col(class_id).cast("string"), F.lit(")"))
        )
    return joined.withColumns({k: v for k, v in filled.items() if k not in taken})


def add_threat_intel(alerts: DataFrame):
    """Alerts with a threat_intelligence struct; null for benign rows and unknown classes never fail."""
    wide = join_knowledge_base(alerts)
    return wide.withColumn("threat_intelligence", intel_from_kb()).select(*alerts.columns, "threat_intelligence")


def lookup_entry(queries: DataFrame, name="query", hits="hits"):
    """Pick the entry of a name from its nearest entries (structs with id).

    The first hit whose name contains the query wins, else the nearest one; up to three other
    names are given as similar.
    """
    named = F.transform(F.col(hits), lambda h: F.struct(h["id"].alias("id"), label_name(h["id"]).alias("name")))
    wanted = F.lower(F.col(name))
    containing = F.filter(F.col("_named"), lambda h: F.contains(F.lower(h["name"]), wanted))
    direct = F.coalesce(F.get(containing, F.lit(0)), F.get(F.col("_named"), F.lit(0)))
    others = F.filter(F.col("_named"), lambda h: h["id"] != F.col("_direct")["id"])
    return (
        queries.withColumn("_named", named).withColumn("_direct", direct)
        .withColumn("attack_id", F.col("_direct")["id"])
        .withColumn("top_result", F.col("_direct")["name"])
        .withColumn("similar_threats", F.transform(F.slice(others, 1, 3), lambda h: h["name"]))
        .drop("_named", "_direct")
    )


def precision_at_1(looked_up: DataFrame, name="query"):
    """Share of names whose top result is that very name."""
    match = F.lower(F.trim(F.col("top_result"))) == F.lower(F.trim(F.col(name)))
    return looked_up.agg(
        F.count_if(match).alias("correct"), F.count("*").alias("total"),
    ).withColumn("precision_at_1", F.round(F.col("correct") / F.greatest("total", F.lit(1)), 4))


def _roots(codes):
    return F.array_distinct(F.transform(codes, technique_root))


def _coverage_columns():
    tactics = F.size(F.array_intersect("true_tactics", "mitre_tactics"))
    overlap = F.size(F.array_intersect(_roots(F.col("true_techniques")), _roots(F.col("techniques"))))
    n_tactics = F.size("true_tactics")
    return {
        "tactic_recall": F.round(F.when(n_tactics > 0, tactics / n_tactics).otherwise(1.0), 4),
        "technique_overlap": overlap,
        "technique_recall": F.round(overlap / F.greatest(F.size("true_techniques"), F.lit(1)), 4),
    }


def technique_coverage(class_rows: DataFrame):
    """Per class row (class_id, ...): share of the true tactics and techniques the knowledge base names."""
    spark = class_rows.sparkSession
    kb = knowledge_base(spark).withColumnRenamed("attack_id", "class_id")
    truth = technique_truth(spark).withColumnRenamed("attack_id", "class_id")
    joined = class_rows.join(F.broadcast(kb), "class_id").join(F.broadcast(truth), "class_id")
    return joined.withColumns(_coverage_columns()).select(
        *class_rows.columns, "attack_name", "tactic_recall", "technique_overlap", "technique_recall"
    )


def coverage_totals(class_rows: DataFrame):
    """One row over the classes given: distinct tactics and technique roots named, true and shared, mean recalls."""
    spark = class_rows.sparkSession
    kb = knowledge_base(spark).withColumnRenamed("attack_id", "class_id")
    truth = technique_truth(spark).withColumnRenamed("attack_id", "class_id")
    joined = class_rows.select("class_id").join(F.broadcast(kb), "class_id").join(F.broadcast(truth), "class_id")
    scored = joined.withColumns(_coverage_columns())

    def union(column):
        return F.array_distinct(F.flatten(F.collect_list(column)))

    totals = scored.agg(
        union(F.col("mitre_tactics")).alias("kt"), union(F.col("true_tactics")).alias("gt"),
        union(_roots(F.col("techniques"))).alias("kx"), union(_roots(F.col("true_techniques"))).alias("gx"),
        F.round(F.avg("tactic_recall"), 4).alias("mean_tactic_recall"),
        F.round(F.avg("technique_recall"), 4).alias("mean_technique_recall"),
    )
    shared_t, shared_x = F.size(F.array_intersect("kt", "gt")), F.size(F.array_intersect("kx", "gx"))
    return totals.select(
        F.size("kt").alias("kb_tactics"), F.size("gt").alias("true_tactics"), shared_t.alias("shared_tactics"),
        F.round(shared_t / F.greatest(F.size("gt"), F.lit(1)), 4).alias("tactic_coverage"),
        F.size("kx").alias("kb_techniques"), F.size("gx").alias("true_techniques"),
        shared_x.alias("shared_techniques"),
        F.round(shared_x / F.greatest(F.size("gx"), F.lit(1)), 4).alias("technique_coverage"),
        "mean_tactic_recall", "mean_technique_recall",
    )


def mapping_by_class(preds: DataFrame, by=("config",)):
    """Per config and attack class: detection recall and whether the knowledge base shares a technique / tactic."""
    by = list(by)
    spark = preds.sparkSession
    classes = class_counts_from(confusion_counts(preds, by), by).filter("class_id != 0")
    kb = knowledge_base(spark).withColumnRenamed("attack_id", "class_id")
    truth = technique_truth(spark).withColumnRenamed("attack_id", "class_id")
    joined = classes.join(F.broadcast(kb), "class_id").join(F.broadcast(truth), "class_id")
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return joined.select(
        *by, "class_id", "attack_name", F.round(recall, 4).alias("detection_recall"),
        F.arrays_overlap(_roots(F.col("true_techniques")), _roots(F.col("techniques"))).alias("technique_match"),
        F.arrays_overlap("true_tactics", "mitre_tactics").alias("tactic_match"),
    )


def mapping_consistency(preds: DataFrame, by=("config",)):
    """Per config: share of attack classes whose knowledge-base entry names a true technique."""
    return mapping_by_class(preds, by).groupBy(*by).agg(
        F.round(F.avg(F.col("technique_match").cast("double")), 4).alias("technique_consistency_rate"),
        F.count("*").alias("n_attacks_evaluated"),
    )
