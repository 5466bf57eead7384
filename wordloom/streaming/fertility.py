"""Running word counts and fertility over arriving documents: an extension of the batch measures to streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import count_words, normalized, pretoken_characters


def running_counts(arrivals: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, lang, n_docs, n_words, n_chars) per window of arrival; arrivals later than the watermark are left out.

    Works on batches too. n_chars are the characters of the pre-tokens, the tokens of a tokenizer without merges.
    """
    rows = arrivals.withWatermark(time, late) if arrivals.isStreaming else arrivals
    return summed_counts(sized(rows), time, window)


def sized(rows: DataFrame) -> DataFrame:
    """rows with the words w and characters c of their text in its place: narrow enough to be joined with times of arrival."""
    staged = rows.withColumn("_norm", normalized(F.col("text"), None)).withColumn("w", count_words(F.col("text")))
    return staged.withColumn("c", pretoken_characters(F.col("_norm"))).drop("text", "_norm")


def summed_counts(counted: DataFrame, time: str = "ts", window: str = "5 minutes") -> DataFrame:
    """running_counts of rows (time, lang, w, c)."""
    return counted.groupBy(F.window(time, window).alias("win"), "lang").agg(F.count("*").alias("n_docs"), F.sum("w").alias("n_words"), F.sum("c").alias("n_chars")).select(F.col("win.start").alias("start"), "lang", "n_docs", "n_words", "n_chars")


def fertility(counts: DataFrame) -> DataFrame:
    """counts with characters per word; null for windows without a word."""
    return counts.withColumn("fertility", F.try_divide(F.col("n_chars").cast("double"), F.col("n_words").cast("double")))
