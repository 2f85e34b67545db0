"""The stages of the pipeline, one after the other, against what each may do."""

import corpus_pipeline
from flowspark.llm import bpe, decontaminate, ngram_join
from flowspark.llm.queries import QUERIES, tokenizer_file


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "bpe"]
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contamination(docs, bench).where("contaminated").count() == 0
    groups = ngram_join.similar_groups(docs, 5, 80).where("n_shingles > 0")
    assert groups.count() == groups.select("component_id").distinct().count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    want = bpe.digests(docs, tokenizer_file(), 50)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last.collect()))
