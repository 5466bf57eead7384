"""Scripts, aksharas (orthographic syllables) and grapheme clusters."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Script names with their block ranges, in the order in which they are tried.
BLOCKS = (
    ("Latin", ((0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F))),
    ("Devanagari", ((0x0900, 0x097F),)),
    ("Telugu", ((0x0C00, 0x0C7F),)),
    ("Arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("Bengali", ((0x0980, 0x09FF),)),
    ("Gurmukhi", ((0x0A00, 0x0A7F),)),
    ("Tamil", ((0x0B80, 0x0BFF),)),
    ("Kannada", ((0x0C80, 0x0CFF),)),
    ("Malayalam", ((0x0D00, 0x0D7F),)),
    ("Odia", ((0x0B00, 0x0B7F),)),
    ("Gujarati", ((0x0A80, 0x0AFF),)),
    ("Digits", ((0x0030, 0x0039),)),
)
#: Scripts whose conjuncts are kept whole, with their signs that join consonants.
JOINERS = {
    "Devanagari": r"\x{94D}",
    "Bengali": r"\x{9CD}",
    "Gurmukhi": r"\x{A4D}",
    "Gujarati": r"\x{ACD}",
    "Oriya": r"\x{B4D}",
    "Telugu": r"\x{C4D}",
    "Kannada": r"\x{CCD}",
    "Malayalam": r"\x{D3B}\x{D3C}\x{D4D}",
    "Sinhala": r"\x{DCA}",
}


def _akshara_pattern() -> str:
    """A character with the marks and joiners behind it; a letter goes on with the unit if a joining sign of its own
    script, and at most one zero-width joiner, stands right in front of it."""
    joined = [rf"(?:(?<=[{signs}])|(?<=[{signs}]\x{{200D}}))[\p{{Lo}}&&\p{{Is{name}}}]" for name, signs in JOINERS.items()]
    return r"(?s).(?:[\p{M}\x{200C}\x{200D}]|" + "|".join(joined) + ")*+"


AKSHARA = _akshara_pattern()
#: What a unit of several characters holds at least one of.
MARKED = r"[\p{M}\x{200C}\x{200D}]"
GRAPHEME = r"\X"


def script_of(token: Column) -> Column:
    """The first script of BLOCKS with a character in the token, else Other."""
    out = None
    for name, ranges in BLOCKS:
        hit = token.rlike("[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def aksharas(word: Column) -> Column:
    """array<string> of a word's units, for the scripts of JOINERS; Tamil letters and all others never join."""
    return F.regexp_extract_all(word, F.lit(AKSHARA), F.lit(0))


def aksharas_folded(word: Column) -> Column:
    """The same units by a fold over the characters: what has been cut off, the open unit, whether a letter may go on with it (2:
    also behind a joiner), and of which script. A letter is tried against the scripts of JOINERS, a sign against their signs."""
    signs = {name: f"[{signs}]" for name, signs in JOINERS.items()}

    def pick(c: Column, patterns: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(c.rlike(p), name) for name, p in patterns.items()], F.lit(""))

    def step(s: Column, c: Column) -> Column:
        sign, letter = pick(c, signs), pick(c, {name: rf"[\p{{Lo}}&&\p{{Is{name}}}]" for name in JOINERS})
        stays = c.rlike(r"[\p{M}\x{200C}\x{200D}]") | ((s["opens"] > 0) & (letter != "") & (letter == s["script"]))
        first = s["now"] == ""
        return F.struct(
            F.when(first | stays, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"),
            F.when(first | stays, F.concat(s["now"], c)).otherwise(c).alias("now"),
            F.when(sign != "", 2).when((s["opens"] == 2) & (c == "\u200d"), 1).otherwise(0).alias("opens"),
            F.when(sign != "", sign).otherwise(s["script"]).alias("script"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("opens"), F.lit("").alias("script"))
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


@functools.cache
def _kind(ch: str) -> tuple[str, str]:
    """(kind, script) of a character: virama, mark, joiner, letter or other, by the character database."""
    category, script = unicodedata.category(ch), unicodedata.name(ch, " ").split(" ")[0]
    if category[0] == "M":
        return ("virama" if unicodedata.combining(ch) == 9 else "mark"), script
    if ch in "\u200c\u200d":
        return ("joiner" if ch == "\u200d" else "mark"), script
    return ("letter" if category == "Lo" and script != "TAMIL" else "other"), script


#: What a unit is open to behind a character of a kind, if it was open to something before; all else leaves it closed.
_OPENS = {("closed", "virama"): "letter or joiner", ("letter or joiner", "virama"): "letter or joiner", ("letter", "virama"): "letter or joiner", ("letter or joiner", "joiner"): "letter"}


def akshara_list(word: str) -> list[str]:
    """Units of one word for any script: marks and joiners go on with a unit, and so does a letter right behind a virama of its
    script, with at most one zero-width joiner between them."""
    cuts, state, joined = [], "closed", ""
    for at, ch in enumerate(word):
        kind, script = _kind(ch)
        if kind == "other" or (kind == "letter" and (state == "closed" or script != joined)) or not at:
            cuts.append(at)
        state = _OPENS.get((state, kind), "closed")
        joined = script if kind == "virama" else joined
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]


@F.pandas_udf(ArrayType(StringType()))
def aksharas_any(words: pd.Series) -> pd.Series:
    """aksharas of words in any script; send distinct words."""
    return words.map(lambda w: None if w is None else akshara_list(w))


def graphemes(word: Column) -> Column:
    """Clusters by Java's rules, which cut conjuncts: a weaker cross-check than aksharas."""
    return F.regexp_extract_all(word, F.lit(GRAPHEME), F.lit(0))


def boundaries(units: Column) -> Column:
    """Character offsets inside a word at which its units meet."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))
    add = lambda s, u: F.struct((s["at"] + F.length(u)).alias("at"), F.concat(s["cuts"], F.array(s["at"] + F.length(u))).alias("cuts"))
    return F.aggregate(units, start, add, lambda s: F.slice(s["cuts"], 1, F.greatest(F.size(s["cuts"]) - 1, F.lit(0))))


def bad_splits(units: Column, pieces: Column) -> Column:
    """How many boundaries between pieces fall inside a unit."""
    return F.size(F.array_except(boundaries(pieces), boundaries(units)))


def token_kind(token_id: Column, specials: int, chars: int, fixed: int) -> Column:
    """special, char, akshara or learned, by the sections of the id range."""
    return F.when(token_id < specials, "special").when(token_id < specials + chars, "char").when(token_id < specials + chars + fixed, "akshara").otherwise("learned")


def starts_with_mark(token: Column) -> Column:
    """Whether a token starts, behind its word mark, with a combining mark or a joiner."""
    return token.rlike(r"^▁*[\p{M}\x{200C}\x{200D}]")
