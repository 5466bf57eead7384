"""One query per operator over its whole table, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import differencing, langid, lexical, mixing, packing, pii, quality_model, quality_rules, secrets, simhash, token_counts, topk, vector_codes
from wordloom.session import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents with the components that near-duplicates form; odd rows: simhash.simhash_components."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents before and after edits, from segment trees; odd rows: token_counts.edited_token_counts."""
    import public_tokenizers

    return token_counts.edited_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of documents; odd rows: quality_rules.quality_rules."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, and what it alone removes, from the ledger's bits."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents that the forest confirms; odd rows: secrets.secret_scan."""
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector; odd rows: topk.exact_top_k."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents, of the base and discovered; odd rows: pii.personal_data."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; odd rows: packing.best_fit_packing."""
    import public_tokenizers

    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; odd rows: mixing.mix."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents; odd rows: quality_model.quality_scores."""
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents; odd rows: langid.language_id."""
    return langid.language_id(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of embeddings with their errors."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal windows of 4096 ids over documents."""
    import public_tokenizers

    return differencing.differencing_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_quality_rules": op3_quality_rules,
        "quality_rule_ablations": quality_rule_ablations,
        "op4_secret_scan": op4_secret_scan,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_personal_data": op6_personal_data,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_source_mixing": op8_source_mixing,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_language_id": op10_language_id,
        "op11_vector_codes": op11_vector_codes,
        "op12_lexical_search": op12_lexical_search,
        "op13_differencing_packing": op13_differencing_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "quality_rule_ablations": quality_rules.ABLATIONS_SQL,
        "op5_exact_top_k": topk.ORACLE_SQL,
        "op8_source_mixing": mixing.ORACLE_SQL,
        "op11_vector_codes": vector_codes.ORACLE_SQL,
        "op12_lexical_search": lexical.ORACLE_SQL,
    }
