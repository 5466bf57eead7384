"""Measures of a tokenizer: fertility, spread, score, unknown tokens, cut aksharas, checks, sensitivity to the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.script import aksharas, bad_splits, boundaries
from wordloom.functions.text import bare_pretokens, count_words, normalized, pretoken_characters, pretokens, truncated_ratio
from wordloom.operators.bpe import UNKNOWN, decoded, encoded, segment_words
from wordloom.operators.corpus import composed
from wordloom.session import checkpointed


def violations(word: Column, tokens: Column) -> Column:
    """Token boundaries inside an akshara of the word that the tokens spell; a word with byte tokens counts one."""
    spelled = F.array_join(tokens, "")
    return F.when(F.exists(tokens, lambda t: F.startswith(t, F.lit("<0x"))), 1).otherwise(bad_splits(aksharas(spelled), tokens))


def grapheme_violations(units: Column, tokens: Column) -> Column:
    """The same against any list of units, with offsets that stay right behind an unknown token."""
    return F.size(F.array_except(boundaries(tokens), boundaries(units)))


def evaluate(corpus: DataFrame, merges: list[tuple[str, str]], keys: tuple[str, ...], alphabet: set[str] | None = None, byte_fallback: bool = False, check_aksharas: bool = True, text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(*keys, tokens, words, unk, violations, fertility) of each group of texts, or of counted ones.

    Distinct words are segmented once; their token counts are joined back to the counts per group. Words are counted on
    the text itself, in the same scan. fertility is null for a group without a word; null texts count as empty. counts, rows
    (*keys, word, n) as counted_with_words gives them, saves that scan.
    """
    each = checkpointed(counted_with_words(corpus, keys, text_col)) if counts is None else counts
    cut = segment_words(each.select("word").where("word is not null").distinct(), merges, alphabet, byte_fallback)
    bad = violations(F.col("word"), F.col("tokens")) if check_aksharas else F.lit(0)
    sized = cut.select("word", F.size("tokens").alias("t"), F.size(F.filter("tokens", lambda x: x == UNKNOWN)).alias("u"), bad.alias("v"))
    total = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).cast("long")
    words = F.sum(F.when(F.col("word").isNull(), F.col("n")).otherwise(0)).cast("long")
    met = each.join(sized, "word", "left").groupBy(*keys).agg(total("t").alias("tokens"), words.alias("words"), total("u").alias("unk"), total("v").alias("violations"))
    return met.withColumn("fertility", F.try_divide(F.col("tokens").cast("double"), F.col("words").cast("double")))


def counted_with_words(corpus: DataFrame, keys: tuple[str, ...], text_col: str = "text", written: Callable[[Column], Column] | None = None) -> DataFrame:
    """(*keys, word, n): occurrences of pre-tokens; the row without a word has the words of the texts. One scan for both.

    written is done to each distinct word; it leaves white space and the mark as they are and makes none.
    """
    total = F.coalesce(count_words(F.col(text_col)), F.lit(0))
    staged = corpus.select(*keys, normalized(F.coalesce(text_col, F.lit("")), None).alias("_norm"), total.alias("_total"))
    # The words of a text stand in front of its pre-tokens as one more element, which no pre-token equals: it has blanks.
    listed = F.concat(F.array(F.concat(F.lit(" "), F.col("_total").cast("string"))), bare_pretokens(F.col("_norm")))
    sums = staged.select(*keys, F.explode(listed).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    marked = F.startswith("word", F.lit(" "))
    split = sums.select(*keys, F.when(~marked, F.col("word")).alias("word"), F.when(marked, F.col("n") * F.trim("word").try_cast("long")).otherwise(F.col("n")).alias("n"))
    return composed(split, keys, written)


def spread(measured: DataFrame, group: tuple[str, ...] = (), name: str = "lang", order: str | None = None) -> DataFrame:
    """(*group, max_*, min_*, spread_num, spread_den, spread, score): from rows (name, tokens, words).

    The spread is an exact fraction in lowest terms; score is 1000 / spread, null where the spread is 0. Ties go to the
    first name by `order`. Rows without words are left out.
    """
    place = F.col(order or name)
    rows = measured.where("words > 0")
    value = F.col("tokens").cast("double") / F.col("words").cast("double")
    # min_by takes the smallest (fertility, place); for the maximum the sign of the fertility is turned.
    pick = F.struct(F.col(name).alias("name"), F.col("tokens").cast("decimal(19,0)").alias("t"), F.col("words").cast("decimal(19,0)").alias("w"))
    both = rows.groupBy(*group).agg(F.min_by(pick, F.struct((-value).alias("f"), place.alias("p"))).alias("hi"), F.min_by(pick, F.struct(value.alias("f"), place.alias("p"))).alias("lo"))
    num = (F.col("hi.t") * F.col("lo.w") - F.col("lo.t") * F.col("hi.w")).cast("decimal(38,0)")
    den = (F.col("hi.w") * F.col("lo.w")).cast("decimal(38,0)")
    cut = both.withColumn("num", num).withColumn("den", den).withColumn("g", greatest_divisor(F.col("num"), F.col("den")))
    small = cut.withColumn("spread_num", F.call_function("div", F.col("num"), F.col("g"))).withColumn("spread_den", F.call_function("div", F.col("den"), F.col("g")))
    exact = F.col("spread_num").cast("double") / F.col("spread_den").cast("double")
    return small.select(
        *group,
        F.col("hi.name").alias(f"max_{name}"),
        F.col("lo.name").alias(f"min_{name}"),
        (F.col("hi.t").cast("double") / F.col("hi.w").cast("double")).alias("max_fertility"),
        (F.col("lo.t").cast("double") / F.col("lo.w").cast("double")).alias("min_fertility"),
        F.col("spread_num").cast("string").alias("spread_num"),
        F.col("spread_den").cast("string").alias("spread_den"),
        exact.alias("spread"),
        F.try_divide(F.lit(1000.0) * F.col("spread_den").cast("double"), F.col("spread_num").cast("double")).alias("score"),
    )


def greatest_divisor(a: Column, b: Column, steps: int = 190) -> Column:
    """Greatest common divisor of decimals by Euclid's steps; 190 are enough for 38 digits."""
    start = F.struct(F.greatest(a, b).cast("decimal(38,0)").alias("x"), F.least(a, b).cast("decimal(38,0)").alias("y"))
    zero = F.lit(0).cast("decimal(38,0)")

    def step(s: Column, _: Column) -> Column:
        return F.when(s["y"] == zero, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).cast("decimal(38,0)").alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["x"])


def round_trip(texts: DataFrame, merges: list[tuple[str, str]], key: str, alphabet: set[str] | None = None, byte_fallback: bool = False) -> DataFrame:
    """(key, ok) of each row: whether the tokens of its text decode to the normalised text. Null texts count as empty."""
    norm = texts.select(key, normalized(F.coalesce("text", F.lit(""))).alias("norm"))
    cut = norm.select(key, "norm", encoded(pretokens(F.col("norm")), merges, alphabet, byte_fallback).alias("p"))
    return cut.select(key, (decoded(F.flatten("p")) == F.col("norm")).alias("ok"))


def decimals(a: Column, b: Column, digits: int = 12) -> Column:
    return truncated_ratio(a, b, digits)


def checks(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check, pass, detail) from named one-row DataFrames with columns pass and detail."""
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("check"), F.col("pass"), F.col("detail"))
        out = one if out is None else out.unionByName(one)
    return out


def compared(first: DataFrame, second: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(check, pass, detail): two reports on the same keys, value by value; a key that one of them lacks fails."""
    a, b = (df.select(key, *[F.col(c).cast("string").alias(f"{side}_{c}") for c in columns]) for df, side in ((first, "a"), (second, "b")))
    met = a.join(b, key, "full_outer")
    each = F.explode(F.array(*[F.struct(F.concat(F.col(key).cast("string"), F.lit(f": {c}")).alias("check"), F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).alias("pass"), F.concat(F.coalesce(f"a_{c}", F.lit("-")), F.lit(" / "), F.coalesce(f"b_{c}", F.lit("-"))).alias("detail")) for c in columns]))
    return met.select(each.alias("c")).select("c.*")


def largest_change(variants: DataFrame, pinned: DataFrame, key: str = "lang", value: str = "fertility") -> DataFrame:
    """(variant, largest): the largest absolute difference of a variant's values from the pinned ones."""
    met = variants.join(pinned.select(key, F.col(value).alias("_pinned")), key)
    return met.groupBy("variant").agg(F.max(F.abs(F.col(value) - F.col("_pinned"))).alias("largest"))


def character_level(corpus: DataFrame, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(*keys, tokens, words): what a tokenizer without merges gives, one token per character of each pre-token."""
    staged = corpus.select(*keys, normalized(F.col(text_col), None).alias("_norm"), count_words(F.col(text_col)).alias("w"))
    each = staged.select(*keys, pretoken_characters(F.col("_norm")).alias("t"), "w")
    return each.groupBy(*keys).agg(F.sum("t").alias("tokens"), F.sum("w").alias("words"))
