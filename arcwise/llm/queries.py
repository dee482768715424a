"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from arcwise.llm import decontaminate, exact, lines, mixing, quality, secrets, simhash, substring, suffix, tokens
from arcwise.llm.common import documents

QUERIES: dict = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir))


@query
def op2_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_quality_classifier(spark, sf_dir):
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "score", "keep")


@query
def op4_decontaminate(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, sf_dir), bench).select("doc_id", "item_id", "distance")


@query
def op5_simhash_dedup(spark, sf_dir):
    return simhash.near_dedup(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query
def op6_suffix_dedup(spark, sf_dir):
    return suffix.suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op7_line_dedup(spark, sf_dir):
    return lines.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "kept_sha256")


@query
def op8_token_counts(spark, sf_dir):
    return tokens.token_counts(documents(spark, sf_dir)).select("doc_id", "n_tokens", "n_edited_tokens", "n_reencoded")


@query
def op9_mix_sources(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_secret_scan(spark, sf_dir):
    return secrets.find_secrets(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


ORACLES |= {"op1_exact_dedup": exact.ORACLE, "op7_line_dedup": lines.ORACLE}
