"""Training-data pipeline over documents: language, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver, and run(), write it as Parquet and hand the
next stage what they read again. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import langid, mixing, packing, secrets, simhash
from wordloom.session import dropped, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised: not those without a letter, nor those that are further from
    every centroid than the language's own texts ever are. lang becomes the recognised language.

    Learns, as op10 does, from rows whose crc32(doc_id as text) mod 4 is not 2.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~held))
    made = langid.predict(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return made.where(~F.col("lang_rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the smallest doc_id, of rows that repeat it the one whose text has
    the smallest hash, and one of equal rows. Documents without a doc_id come after all others of their group."""
    return simhash.first_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret that the forest confirms by a mark; documents stay."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents of the mix with their sequences; a document that the mix repeats has its pieces as often."""
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", language),
    ("simhash near-dedup", near_dedup),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: Language models and tokenizers have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what the stage before left there goes as
    soon as the next one has read it.

    Null texts and languages go in the first stage, and so does everything of an empty table; null ids, sources and other
    columns and very long texts pass all stages; repeated rows end in the second. Columns beyond those of documents are
    dropped by the first stage.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage{k}")
            docs.write.parquet(path)
            if before:
                dropped(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
