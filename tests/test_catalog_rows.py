"""Registered queries on rows of the tests' own."""

import datetime
import re

from pyspark.sql import functions as F

from flowspark.catalog import all_queries
from flowspark.knowledge import TACTICS, TRUTH
from flowspark.operators.text_index import TextIndex, word_counts
from flowspark.schema import LABELS

QUERIES = all_queries()


def events(spark, path, n=3):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, 5, start + datetime.timedelta(seconds=i), "view", 1.0, '{"k": 30}') for i in range(n)]
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_every_class_is_looked_up(spark, tmp_path):
    """All flows are benign: the other 14 names are looked up all the same."""
    found = QUERIES["threat_lookup"][0](spark, events(spark, tmp_path)).collect()
    assert {r["query"]: r.top_result for r in found} == {n: n for i, n in LABELS.items() if i}
    assert {(r.n, r.n_similar) for r in found} == {(3, 3)}


def test_totals_cover_every_class(spark, tmp_path):
    """All flows are benign: the knowledge of the other classes is covered all the same."""
    total = QUERIES["coverage_totals"][0](spark, events(spark, tmp_path)).first()
    assert total.kb_tactics == len({t for of_class in TACTICS.values() for t in of_class})
    assert total.true_tactics == len({t for tactics, _ in TRUTH.values() for t in tactics})


def test_words_are_counted_text_by_text(spark):
    rows = [("b a b  B.1 a b é",), ("x",), ("",), (None,), (" , ",)]
    counted = spark.createDataFrame(rows, "t string").select(word_counts(F.col("t")).alias("c"))
    assert [[tuple(c) for c in r.c] for r in counted.collect()] == [[("a", 2), ("b", 3), ("b.1", 1), ("é", 1)], [("x", 1)], [], [], []]
    index = TextIndex.fit(spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string"))
    found = index.search(spark.createDataFrame(rows, "t string"), "t", 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_key#" in plan and not re.search(r"Aggregate \[_key#\d+, word#", plan)
