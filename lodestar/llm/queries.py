"""The opN_ queries of this subpackage and their SQL: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hash_tree, host_rules, importance, improbable, lm_scoring, main_text, mixing, periodic, pieces, simhash, token_counts, toxicity, warc
from .common import table


def piece_model() -> str:
    """The default model path: the installed public vocabulary (never copied here)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_against_labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(table(spark, sf_dir, "documents"), piece_model()))


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_host_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_model())


def op11_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(table(spark, sf_dir, "documents"), hash_tree.layout(16)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_importance_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.with_planted_repeats(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_cross_entropy_difference, op2_simhash_pivots, op3_source_mixing, op4_host_suffix_array, op5_improbable_features, op6_piece_codec, op7_warc_dictionary,
        op8_host_rules, op9_ordinal_toxicity, op10_token_counts, op11_hash_tree, op12_importance_postings, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.oracle_sql(), "op7_warc_dictionary": warc.oracle_sql(), "op8_host_rules": host_rules.oracle_sql(), "op11_hash_tree": hash_tree.oracle_sql(), "op12_importance_postings": importance.oracle_sql()}
