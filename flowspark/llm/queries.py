"""One query for each operator over its whole table: name -> (function(spark, sf_dir), DuckDB statement or None)."""

import os

from pyspark.sql import functions as F

from flowspark.llm import (
    bpe, chat, decontaminate, filter_audit, language_id, license_scan, line_dedup, ngram_join, piece_bpe, token_alignment,
    url_filter, vector_join, warc,
)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name="word_bpe_49k.json"):
    """The place of a vocabulary; FLOWSPARK_TOKENIZER names another file."""
    given = os.environ.get("FLOWSPARK_TOKENIZER")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(name):
    """The place of a vocabulary file by its name; FLOWSPARK_VOCABULARIES names another folder."""
    folder = os.environ.get("FLOWSPARK_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def line_dedup_query(spark, sf_dir):
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.char_length("text").cast("long").alias("kept_chars"),
                       F.sha2("text", 256).alias("kept_sha256"))


def chat_query(spark, sf_dir):
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_log(rows.unionByName(more))


def ngram_join_query(spark, sf_dir):
    found = ngram_join.similar_links(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def language_query(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


def decontamination_query(spark, sf_dir):
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), proximity=False)
    return found.drop("n_near")


def proximity_query(spark, sf_dir):
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def url_query(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def url_rules_query(spark, sf_dir):
    """What SQL can state of the filter: host, path and the rule that fits."""
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule")


def license_query(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def license_notices_query(spark, sf_dir):
    return license_scan.notices(_table(spark, sf_dir, "documents"))


def warc_query(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def bpe_query(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_file())


def vector_query(spark, sf_dir):
    return vector_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def piece_query(spark, sf_dir):
    return piece_bpe.digests(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def alignment_query(spark, sf_dir):
    return token_alignment.digests(
        _table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def filter_query(spark, sf_dir):
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_line_dedup": (line_dedup_query, line_dedup.SQL),
    "op2_chat_format": (chat_query, chat.SQL),
    "op3_ngram_jaccard": (ngram_join_query, None),
    "op4_language_id": (language_query, None),
    "op5_decontamination": (decontamination_query, decontaminate.SQL),
    "op5_proximity": (proximity_query, None),
    "op6_url_filter": (url_query, None),
    "op6_url_rules": (url_rules_query, url_filter.RULE_SQL),
    "op7_license_notices": (license_notices_query, license_scan.NOTICES_SQL),
    "op7_license_scan": (license_query, license_scan.SQL),
    "op8_warc": (warc_query, warc.SQL),
    "op9_bpe": (bpe_query, None),
    "op10_vector_join": (vector_query, vector_join.SQL),
    "op11_piece_bpe": (piece_query, None),
    "op12_token_alignment": (alignment_query, None),
    "op13_filter_audit": (filter_query, filter_audit.SQL),
}
