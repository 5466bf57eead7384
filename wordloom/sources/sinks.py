"""Writers: partitioned documents, snapshots, ledgers, tokenizers, lists, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import count_words


def write_documents(docs: DataFrame, path: str) -> None:
    """gzip JSON lines in folders lang=*/split=*."""
    docs.write.mode("overwrite").partitionBy("lang", "split").option("compression", "gzip").json(path)


def snapshot_manifest(pages: DataFrame) -> DataFrame:
    """One row per page of (lang, title, revid, raw, text): hashes and counts of its cleaned text."""
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return pages.select("lang", "title", "revid", F.sha2("raw", 256).alias("raw_extract_sha256"), F.sha2("text", 256).alias("clean_text_sha256"), F.sha2(F.concat("text", F.lit("\n")), 256).alias("file_sha256"), F.length("text").alias("chars"), count_words(F.col("text")).alias("words"), lines.alias("lines"))


def write_snapshots(pages: DataFrame, path: str) -> None:
    """Cleaned texts as text files, by language, and the manifest as one JSON file."""
    pages.select("lang", F.col("text").alias("value")).write.mode("overwrite").partitionBy("lang").text(f"{path}/texts")
    snapshot_manifest(pages).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds runs to a ledger; nothing that is there is touched."""
    runs.write.mode("append").json(path)


def write_tokenizer(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    """vocab (id, token, kind) and merges (rank, left, right) as Parquet, and the assembled model as JSON."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").parquet(f"{path}/merges")
    model_json(vocab, merges).coalesce(1).write.mode("overwrite").text(f"{path}/model")


def model_json(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """(value): the compact serialised model, in one row; a vocabulary is small."""
    tokens = vocab.agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "token"))).alias("v"))
    ranks = merges.agg(F.array_sort(F.collect_list(F.struct("rank", "left", "right"))).alias("m"))
    one = tokens.crossJoin(ranks)
    table = F.map_from_entries(F.transform("v", lambda x: F.struct(x["token"], x["id"])))
    pairs = F.transform("m", lambda x: F.array(x["left"], x["right"]))
    return one.select(F.to_json(F.struct(F.lit("BPE").alias("type"), table.alias("vocab"), pairs.alias("merges"))).alias("value"))


def tokenizer_sha(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """(sha256): a tokenizer's identity, the hash of its serialised model."""
    return model_json(vocab, merges).select(F.sha2("value", 256).alias("sha256"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often; the check that replaces a write."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def token_list(vocab: DataFrame) -> DataFrame:
    """(id, token_json, built_from_json): built_from is empty for what no merge built."""
    pair = F.when(F.col("left").isNull(), "").otherwise(F.to_json(F.array("left", "right")))
    text = F.to_json(F.array("token"))
    return vocab.select("id", F.substring(text, F.lit(2), F.length(text) - 2).alias("token_json"), pair.alias("built_from_json"))


def write_token_list(vocab: DataFrame, path: str) -> None:
    token_list(vocab).coalesce(1).orderBy("id").write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON object per row."""
    rows.coalesce(1).write.mode("overwrite").json(path)
