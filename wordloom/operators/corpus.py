"""Corpus operators: pre-token counts, weights, alphabet, aksharas, word budgets, base vocabulary.

A corpus is a DataFrame (lang, source, text). Everything expensive works on distinct words with their counts, which are
far fewer than the words of the texts. Weights are whole micro-weights, so sums do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.script import MARKED, aksharas
from wordloom.functions.text import META, bare_pretokens, count_words, normal_form, normalized, punctuation_pieces, unit_hash
from wordloom.operators.prefix import ranged, with_offsets
from wordloom.session import checkpointed

MICRO = 1_000_000


def word_counts(corpus: DataFrame, keys: tuple[str, ...] = ("lang", "source"), form: str | None = "NFC", punctuation: bool = False, text_col: str = "text") -> DataFrame:
    """(*keys, word, n): occurrences of each pre-token; with punctuation, of its pieces, which are cut in distinct pre-tokens."""
    early = None if form == "NFC" else form
    staged, norm = corpus.select(*keys, normalized(F.col(text_col), early).alias("_norm")), F.col("_norm")  # worked out once per text
    counted = staged.select(*keys, F.explode(bare_pretokens(norm)).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    named = composed(counted, keys) if form == "NFC" else counted.select(*keys, F.concat(F.lit(META), "word").alias("word"), "n")
    return named.select(*keys, F.explode(punctuation_pieces(F.col("word"))).alias("word"), "n").groupBy(*keys, "word").agg(F.sum("n").alias("n")) if punctuation else named


def composed(counts: DataFrame, keys: tuple[str, ...], written: Callable[[Column], Column] | None = None) -> DataFrame:
    """(*keys, word, n): the words of counts in NFC behind a mark, what becomes equal summed; null words stay null. written is
    done to each word before.

    The composed form of a text is that of its words: neither white space nor the mark composes with what follows it, nor do
    marks move across them. So Python gets distinct words, and no text.
    """
    word = F.col("word") if written is None else written(F.col("word"))
    form = normal_form(F.col("_word"))
    staged = counts.select(*keys, word.alias("_word"), "n").select(*keys, F.concat(F.lit(META), form).alias("word"), "n")
    return staged.groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def weighted_counts(counts: DataFrame, weights: DataFrame, on: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(word, mass): sum of n times the micro-weight over languages and sources with a positive weight.

    weights: (*on, micro bigint), a small dimension table; a language or source without a row is left out.
    """
    met = counts.join(weights.where("micro > 0"), list(on))
    return met.groupBy("word").agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("micro")).cast("decimal(38,0)").alias("mass"))


def characters(words: DataFrame, value: str = "mass") -> DataFrame:
    """(char, mass): value per occurrence of each character."""
    return words.select(F.explode(F.split("word", "")).alias("char"), value).where("char <> ''").groupBy("char").agg(F.sum(value).alias(value))


def kept_characters(words: DataFrame, least: int, forced_words: DataFrame | None = None) -> DataFrame:
    """(char): characters whose mass reaches `least`, and every character of forced_words."""
    kept = characters(words).where(F.col("mass") >= least).select("char")
    if forced_words is None:
        return kept
    return kept.unionByName(forced_words.select(F.explode(F.split("word", "")).alias("char")).where("char <> ''")).distinct()


def alphabet_filtered(words: DataFrame, alphabet: DataFrame) -> DataFrame:
    """The words all of whose characters are in the alphabet: characters outside are found once, then words by them."""
    each = words.select("word", F.explode(F.array_distinct(F.split("word", ""))).alias("char")).where("char <> ''")
    bad = each.join(alphabet, "char", "left_anti").select("word").distinct()
    return words.join(bad, "word", "left_anti")


def akshara_masses(words: DataFrame, value: str = "mass") -> DataFrame:
    """(akshara, mass) of units of more than one character."""
    units = words.where(F.col("word").rlike(MARKED)).select(F.explode(F.filter(aksharas(F.col("word")), lambda a: F.length(a) > 1)).alias("akshara"), value)
    return units.groupBy("akshara").agg(F.sum(value).alias(value))


def chosen_aksharas(words: DataFrame, least: int, forced_words: DataFrame | None = None) -> DataFrame:
    """(akshara, mass) that are glued: frequent ones, and those of forced_words; order by mass desc, akshara."""
    masses = akshara_masses(words)
    frequent = masses.where(F.col("mass") >= least)
    if forced_words is None:
        return frequent
    forced = akshara_masses(forced_words.select("word", F.lit(1).alias("mass"))).select("akshara")
    return masses.where(F.col("mass") < least).join(forced, "akshara", "left_semi").unionByName(frequent)


def rounded_counts(words: DataFrame, total_mass: int = 6_000_000) -> DataFrame:
    """(word, k) and further columns: masses scaled to a total and rounded without bias: floor(x + u), u from the word's hash."""
    total = words.agg(F.sum("mass").cast("double").alias("total"))
    scaled = words.crossJoin(F.broadcast(total))  # one row
    return scaled.select(*[c for c in words.columns if c != "mass"], F.floor(F.col("mass").cast("double") * (F.lit(float(total_mass)) / F.col("total")) + unit_hash(F.col("word"))).alias("k"))


def within_budget(docs: DataFrame, cap: int, group: tuple[str, ...] = ("lang", "split"), order: str = "doc_id", words: Column | None = None) -> DataFrame:
    """The documents of each group, in order, until their words reach the cap; the one that crosses it is kept. Column
    words_before: the words of its group in front of it. All columns of docs are sorted by range; pass narrow ones, with words."""
    counted = docs.withColumn("n_words", count_words(F.col("text")) if words is None else words)
    cut = ranged(checkpointed(counted.withColumn("_tie", F.monotonically_increasing_id())), [*group, order, "_tie"])  # ranges read it twice
    return with_offsets(cut, list(group), [order, "_tie"], F.col("n_words"), "words_before").where(F.col("words_before") < cap).drop("_chunk", "_tie")


def base_vocabulary(words: DataFrame, specials: tuple[str, ...] = ("<unk>",), byte_fallback: bool = False) -> DataFrame:
    """(id, token, kind): specials, byte tokens if asked for, then the characters in code-point order."""
    first = [*specials, *([f"<0x{i:02X}>" for i in range(256)] if byte_fallback else [])]
    spark = words.sparkSession
    chars = words.select(F.explode(F.split("word", "")).alias("token")).where("token <> ''").distinct()
    ranked = with_offsets(ranged(chars, ["token"]), [], ["token"], F.lit(1), "id")
    head = spark.createDataFrame([(i, t, "special" if i < len(specials) else "byte") for i, t in enumerate(first)], "id long, token string, kind string")
    return head.unionByName(ranked.select((F.col("id") + len(first)).alias("id"), "token", F.lit("char").alias("kind")))


def adjacent_pairs(words: DataFrame, value: str = "mass") -> DataFrame:
    """(left, right, mass) of neighbouring characters, per occurrence."""
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return words.select(F.explode(pairs).alias("p"), value).groupBy("p.left", "p.right").agg(F.sum(value).alias(value))


__all__ = ["META", "MICRO", "adjacent_pairs", "akshara_masses", "alphabet_filtered", "base_vocabulary", "characters", "chosen_aksharas", "composed", "kept_characters", "rounded_counts", "weighted_counts", "within_budget", "word_counts"]
