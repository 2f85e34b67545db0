"""Alerts enriched with knowledge-base entries found by class and by similarity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.errors import EnrichmentError
from flowspark.functions.labels import label_name
from flowspark.functions.literals import literal_map
from flowspark.functions.scores import top_predictions
from flowspark.functions.text import retrieval_query, with_prefix
from flowspark.operators.text_index import TextIndex
from flowspark.operators.threat import join_knowledge_base, lookup_entry
from flowspark.sources.stores import knowledge_texts


class KnowledgeSearch:
    """The knowledge base behind an inverted index."""

    def __init__(self, index: TextIndex, texts: DataFrame):
        self.index, self.texts = index, texts

    @classmethod
    def build(cls, spark):
        texts = knowledge_texts(spark)
        prefixed = texts.withColumn("text", with_prefix(F.col("text")))
        return cls(TextIndex.fit(prefixed, "attack_id", "text"), texts)

    def search(self, queries: DataFrame, column="query", k=5, severity=None, name="hits"):
        """Add the k nearest entries (id, distance) of a text column, optionally of one severity only."""
        index = self.index
        if severity is not None:
            index = index.restrict(self.texts.where(F.col("severity") == severity).select(F.col("attack_id").alias("id")))
        asked = queries.withColumn("_q", with_prefix(F.coalesce(F.col(column), F.lit("")), True))
        return index.search(asked, "_q", k, name).drop("_q")

    def lookup(self, names: DataFrame, column="query"):
        """Entry of each class name: nearest five, then the containment rule."""
        asked = names.withColumn("_ask", F.concat(F.lit("Attack: "), F.col(column)))
        return lookup_entry(self.search(asked, "_ask", 5), column).drop("_ask")

    def documents(self):
        return self.texts.select(F.col("attack_id").alias("id"), F.col("text").alias("document"))


def enrich_alerts(alerts: DataFrame, search: KnowledgeSearch, k=3):
    """Alerts (attack_id, probs, statistics columns) with entry fields, context and top predictions.

    For known classes the retrieval sentence takes at most 15 * 2**6 values, so each distinct
    sentence is searched once and joined back to the alerts; Spark picks the form of the join. Without a
    knowledge base, or the columns it needs, it raises EnrichmentError, after which the alerts stand.
    """
    missing = [c for c in ("attack_id", "probs") if c not in alerts.columns]
    if search is None or missing:
        raise EnrichmentError("retrieval", "no knowledge base" if search is None else f"columns {missing} are missing")
    name = label_name(F.col("attack_id"), F.concat(F.lit("Unknown ("), F.col("attack_id").cast("string"), F.lit(")")))
    asked = alerts.withColumn("query_text", retrieval_query(name))
    hits = search.search(asked.select("query_text").distinct(), "query_text", k)
    documents = {r["id"]: r["document"][:400] for r in search.documents().collect()}
    text = literal_map(documents)
    context = F.transform(F.slice(F.col("hits"), 1, 2), lambda h: F.try_element_at(text, h["id"]))
    hits = hits.withColumn("rag_context", context).withColumnRenamed("hits", "retrieved")
    joined = join_knowledge_base(asked.join(hits, "query_text", "left").withColumn("attack_name", name))
    return joined.withColumns({
        "techniques": F.slice("techniques", 1, 5),
        "top_predictions": top_predictions(F.col("probs"), 3),
    })


