"""Documents from raw rows to token ids: five stages, each a written table that the next one reads.

Part of the operators in flowspark/llm. Every stage gets (spark, docs, sf_dir) and works on all rows
its predecessor kept; all but the last return the columns of documents.
"""

from flowspark.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from flowspark.llm.queries import tokenizer_file
from flowspark.session import materialise


def told_language(spark, docs, sf_dir):
    """Documents whose language is told; their columns stay as they are."""
    return language_id.keep_identified(docs)


def without_repeated_lines(spark, docs, sf_dir):
    """Later copies of line runs go, and with them documents that consist of nothing else.

    n_chars becomes the length of what is left. Documents that were empty before stay.
    """
    kept = line_dedup.dedup_lines(docs)
    rows = kept.where("n_lines = 0 or n_deleted < n_lines")
    return rows.selectExpr(*[
        "cast(char_length(text) as long) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def one_of_each_group(spark, docs, sf_dir):
    """One document of every group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_one_of_each_group(docs, words=5, percent=80)


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark, docs, sf_dir):
    """doc_id, number of tokens, digests of the ids and of the decoded text."""
    return bpe.digests(docs, tokenizer_file())


STAGES = [
    ("language_id", told_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe", token_ids),
]

#: The first and the last stage are a trained model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
