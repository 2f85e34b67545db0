"""Inverted index over short texts: weighted word postings, and search by summed products.

A word weighs its count times ln((entries + 1) / (entries with the word + 1)), and a text has length 1,
so a sum of products is a cosine. Searching joins the words of the texts with the postings and sums per
(text, entry); texts without a common word need no work.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.literals import literal_array
from flowspark.functions.scores import let
from flowspark.session import materialise

DIGITS = 9


def words(text):
    """Lower-cased runs of letters, digits and dots of a text column."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}.]+"), lambda w: w != "")


def word_counts(text):
    """(word, tf) for every distinct word of a text: the lengths of the runs of its sorted words.

    A text is counted by itself, so memory goes with one text and not with the texts of a task.
    """

    def starts(s):
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.struct(s.alias("s"), F.when(F.size(s) > 0, at).otherwise(F.array().cast("array<int>")).alias("at"))

    def lengths(r):
        end = lambda j: F.coalesce(F.get(r["at"], j + 1), F.size(r["s"]))
        return F.transform(r["at"], lambda a, j: F.struct(F.get(r["s"], a).alias("word"), (end(j) - a).alias("tf")))

    return let(let(F.sort_array(words(text)), starts), lengths)


class TextIndex:
    """Postings (word, idf, id, weight); a row without id for every word carries its idf alone."""

    def __init__(self, postings: DataFrame, entries, first_ids, keep, id_type):
        self.postings, self.entries, self.first_ids, self.keep, self.id_type = postings, entries, first_ids, keep, id_type

    @classmethod
    def fit(cls, texts: DataFrame, id_column="id", column="text", keep=16):
        """Index the texts; `keep` ids, the smallest, stand by for texts with fewer related entries than asked for."""
        entries = texts.select(F.col(id_column).alias("id"), F.col(column).alias("text"))
        counts = entries.select("id", F.explode(words(F.col("text"))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
        counts = materialise(counts, "index-words")
        n = entries.count()
        idf = counts.groupBy("word").agg(F.log(F.lit(float(n + 1)) / (F.count(F.lit(1)) + 1)).alias("idf"))
        weighted = counts.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
        length = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
        # a word of all entries weighs nothing
        lists = weighted.join(length, "id").where("idf > 0").select("word", "idf", "id", (F.col("w") / F.col("length")).alias("weight"))
        alone = idf.select("word", "idf", F.lit(None).cast(texts.schema[id_column].dataType).alias("id"), F.lit(None).cast("double").alias("weight"))
        first = [r["id"] for r in entries.select("id").distinct().orderBy("id").limit(keep).collect()]
        return cls(materialise(lists.unionByName(alone), "index-postings"), n, first, keep, texts.schema[id_column].dataType.simpleString())

    def restrict(self, allowed: DataFrame):
        """The same weights for the entries of a table (id) alone."""
        first = [r["id"] for r in allowed.select("id").orderBy("id").limit(self.keep).collect()]
        kept = self.postings.join(allowed.select("id"), "id", "left_semi").unionByName(self.postings.where("id IS NULL"))
        return TextIndex(kept.select("word", "idf", "id", "weight"), self.entries, first, self.keep, self.id_type)

    def search(self, queries: DataFrame, column, k, name="hits") -> DataFrame:
        """Add `name`: array of (id, distance), the k nearest entries, nearest first, ties by id.

        Equal texts are searched once. An entry without a common word is at distance 1; an empty text is
        at distance 1 from all. k is at most the `keep` of the index, or the number of entries.
        """
        if k > self.keep and len(self.first_ids) == self.keep:
            raise ValueError(f"k is {k}, the index keeps {self.keep} ids")
        key = F.substring(F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256)), 1, 16)
        keyed = queries.withColumn("_key", key)
        texts = keyed.select("_key", F.col(column).alias("_text")).groupBy("_key").agg(F.first("_text").alias("_text"))
        # for the plain form of the generator Spark may add a check that counts the words a second time
        counted = texts.select("_key", F.inline_outer(word_counts(F.col("_text")))).where("word IS NOT NULL")
        unseen = F.log(F.lit(float(self.entries + 1)))
        w = F.col("tf") * F.coalesce("idf", unseen)
        sums = counted.join(self.postings, "word", "left").groupBy("_key", "id").agg(
            F.sum(w * F.coalesce("weight", w)).alias("product"))
        of_text = Window.partitionBy("_key")
        length = F.sqrt(F.max(F.when(F.col("id").isNull(), F.col("product"))).over(of_text))
        near = sums.withColumn("distance", F.round(1 - F.col("product") / length, DIGITS)).where("id IS NOT NULL")
        near = near.withColumn("_rank", F.row_number().over(of_text.orderBy("distance", "id"))).where(F.col("_rank") <= k)
        # k at most
        found = near.groupBy("_key").agg(F.collect_list(F.struct("distance", "id")).alias("_found"))
        none = F.array().cast(f"array<struct<distance:double,id:{self.id_type}>>")
        spare = literal_array(self.first_ids).cast(f"array<{self.id_type}>")
        held = F.coalesce("_found", none)
        rest = F.filter(spare, lambda i: ~F.exists(held, lambda h: h["id"] == i))
        both = F.concat(held, F.transform(rest, lambda i: F.struct(F.lit(1.0).alias("distance"), i.alias("id"))))
        hits = F.transform(F.slice(F.array_sort(both), 1, k), lambda h: F.struct(h["id"].alias("id"), h["distance"].alias("distance")))
        return keyed.join(found, "_key", "left").withColumn(name, hits).drop("_key", "_found")
