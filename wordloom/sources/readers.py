"""Readers of every file that the pipeline meets: pages, documents, ledgers, tokenizers, configurations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import clean_text, count_words, split_name
from wordloom.operators.corpus import within_budget
from wordloom.operators.ledger import SCHEMA

RAW_PAGE = "lang string, title string, pageid bigint, revid bigint, rev_timestamp string, url string, text string, retrieved_utc string, source string"
DOCUMENT = "id string, title string, text string"
ARTIFACT = """
normalizer string, pre_tokenizer string, post_processor string, decoder string,
model struct<type:string,vocab:map<string,int>,merges:array<string>,unk_token:string,byte_fallback:boolean,ignore_merges:boolean>
"""


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """One multi-line JSON object per file, with the file's name."""
    return spark.read.schema(RAW_PAGE).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """(lang, html): whole files, plain or .gz; the language is the file name up to its first dot."""
    return spark.read.text(path, wholetext=True).select(F.split_part(F.col("_metadata.file_name"), F.lit("."), F.lit(1)).alias("lang"), F.col("value").alias("html"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(lang, text): whole files without the newlines at their end."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.split_part(F.col("_metadata.file_name"), F.lit("."), F.lit(1)).alias("lang"), F.regexp_replace("value", "\n+$", "").alias("text"))


def documents(spark: SparkSession, path: str, max_words: int | None = None) -> DataFrame:
    """Cleaned documents of JSON lines, (lang, split, id, title, text), from folders lang=*/split=*; with max_words, each
    split's documents in id order until their words reach it."""
    rows = spark.read.schema(f"{DOCUMENT}, lang string, split string").option("basePath", path).json(path)
    cleaned = rows.withColumn("text", clean_text(F.col("text")))
    return cleaned if max_words is None else within_budget(cleaned, max_words, order="id").drop("n_words", "words_before")


def heldout_and_train(docs: DataFrame, excluded: DataFrame, caps: dict[str, int], least_words: int = 20) -> DataFrame:
    """Documents (lang, id, title, text) by split: titles in excluded (title) and texts of fewer words go, a tenth of the
    titles is held out, and each split stops at its budget; short documents use none of it."""
    rows = docs.join(excluded.select("title").distinct(), "title", "left_anti").withColumn("text", clean_text(F.col("text")))
    rows = rows.withColumn("n_words", count_words(F.col("text"))).where(F.col("n_words") >= least_words).withColumn("split", split_name(F.col("title")))
    out = None
    for split, cap in caps.items():
        part = within_budget(rows.where(F.col("split") == split), cap, order="id", words=F.col("n_words"))
        out = part if out is None else out.unionByName(part)
    return out.drop("words_before")


def ledger(spark: SparkSession, *paths: str) -> DataFrame:
    """All runs of the ledger files, by file name and line; seq numbers them, blank lines do not count."""
    rows = spark.read.schema(SCHEMA).json(list(paths)).where("id is not null")
    return rows.withColumn("seq", F.concat_ws(":", F.col("_metadata.file_name"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(lang, ...) of a manifest's pages."""
    page = "struct<language:string,project:string,title:string,pageid:bigint,revid:bigint,revision_timestamp:string,retrieved_utc:string,url:string,permanent_url:string,raw_extract_sha256:string,clean_text_sha256:string,file_sha256:string,chars:int,words:int,lines:int>"
    rows = spark.read.schema(f"pages map<string,{page}>").json(path, multiLine=True)
    return rows.select(F.explode("pages").alias("lang", "p")).select("lang", "p.*")


def tokenizer_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(vocab (id, token), merges (rank, left, right), settings) of a tokenizer file; merges as "a b" or ["a", "b"].

    Raises ValueError for what the engine does not do: other models, a post-processor, ignored merges, other normalizers or
    pre-tokenizers than NFC/NFKC with blanks folded and word marks.
    """
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", ARTIFACT).alias("t")).select("t.*")
    head = rows.select("normalizer", "pre_tokenizer", "post_processor", "decoder", "model.type", "model.unk_token", "model.byte_fallback", "model.ignore_merges").first().asDict()
    problems = guard(head)
    if problems:
        raise ValueError("; ".join(problems))
    vocab = rows.select(F.explode("model.vocab").alias("token", "id")).select(F.col("id").cast("long").alias("id"), "token")
    merge = rows.select(F.posexplode("model.merges").alias("rank", "m"))
    pair = F.from_json("m", "array<string>")
    both = F.when(F.startswith("m", F.lit("[")) & (F.size(pair) == 2), pair).otherwise(F.split("m", " ", 2))
    return vocab, merge.select("rank", both[0].alias("left"), both[1].alias("right")), head


def guard(head: dict) -> list[str]:
    """What a tokenizer file asks for that is not supported."""
    normal, pre = (json.loads(head.get(k) or "null") or {} for k in ("normalizer", "pre_tokenizer"))
    found = []
    if head.get("type") not in (None, "BPE"):
        found.append(f"model {head['type']}")
    if head.get("post_processor") not in (None, "null"):
        found.append("a post-processor")
    if head.get("ignore_merges"):
        found.append("ignored merges")
    for part in normal.get("normalizers", [normal] if normal else []):
        if part.get("type") not in ("NFC", "NFKC", "Replace", "Strip"):
            found.append(f"normalizer {part.get('type')}")
    for part in pre.get("pretokenizers", [pre] if pre else []):
        if part.get("type") not in ("Metaspace", "Split"):
            found.append(f"pre-tokenizer {part.get('type')}")
    return found


def weights(spark: SparkSession, path: str) -> DataFrame:
    """(lang, source, micro) of a configuration's weights; keys are cut at their last dot."""
    rows = spark.read.schema("langs array<string>, weights map<string,double>").json(path, multiLine=True)
    pairs = rows.select(F.explode("weights").alias("key", "weight"))
    lang = F.regexp_extract("key", r"^(.*)\.[^.]*$", 1)
    return pairs.select(lang.alias("lang"), F.substring_index("key", ".", -1).alias("source"), F.round(F.col("weight") * 1_000_000).cast("bigint").alias("micro"))


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows at random; the seed gives the same ones for the same partitioning."""
    return rows.orderBy(F.rand(seed)).limit(n)


def page_links(pages: DataFrame, limit: int = 5000) -> DataFrame:
    """(page_id, place, target): the first `limit` links of each page, in order."""
    from wordloom.functions.html import links

    return pages.select("page_id", F.posexplode(F.slice(links(F.col("html")), 1, limit)).alias("place", "target"))
