"""Array helpers made of built-in functions only, for the operators that run no Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, the separator of words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once per row."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """array<string> of the words of text; empty for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def running(lengths: Column) -> Column:
    """Sum of all earlier entries for each entry of an array<int>; blocks of sqrt(n) keep the work far below n squared."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def sums(a: Column) -> Column:
        return F.transform(a, lambda _, i: total(F.slice(a, 1, i)))

    def blocks(a: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda i: F.slice(a, i * width + 1, width))

    def join(cut: Column) -> Column:
        return let(F.transform(cut, total), lambda t: let(sums(t), lambda base: F.flatten(F.zip_with(cut, base, lambda c, b: F.transform(sums(c), lambda x: x + b)))))

    whole = let(lengths, lambda a: let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")), lambda w: let(blocks(a, w), join)))
    return F.when(F.size(lengths) > 0, whole).otherwise(F.array().cast("array<int>"))
