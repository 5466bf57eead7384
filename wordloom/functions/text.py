"""Text columns: cleaning, word counts, normalisation, pre-tokens, hash split. Built-in functions, but for Unicode normal forms.

Patterns spell their characters out and use no look-around unless said, so that Java's regex and RE2 agree on them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space by Unicode property (25 code points), and what Python's str.isspace adds to it.
WHITE_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PYTHON_SPACE = WHITE_SPACE + r"\x{1C}-\x{1F}"
#: What ends a line, and the rest of PYTHON_SPACE.
LINE_ENDS = r"\n\r\x{2028}\x{2029}\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}"
BLANKS = r"\t \x{1F}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
META = "▁"
#: Pieces of a pre-token with punctuation and symbols apart; a leading mark stays with what follows it.
PUNCTUATION_PIECES = r"▁?[\p{P}\p{S}&&[^▁]]+|(?:▁(?![\p{P}\p{S}&&[^▁]])|[^\p{P}\p{S}▁])+"


def _normal_form(form: str):
    @F.pandas_udf(StringType())
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x))

    return convert


def normal_form(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form of text. Spark has no such function; only texts with characters that the form can touch are
    sent to Python (below U+0300 NFC changes nothing, below U+0080 NFKC)."""
    if form not in ("NFC", "NFKC"):
        raise ValueError(f"unknown normal form {form}")
    touched = text.rlike(r"[^\x{00}-\x{2FF}]" if form == "NFC" else r"[^\x{00}-\x{7F}]")
    return F.coalesce(_normal_form(form)(F.when(touched, text)), text)


def clean_text(text: Column, nfc: bool = True) -> Column:
    """Paragraphs, one per line: NFC, other line ends become newlines and other blanks single spaces; empty lines go."""
    text = normal_form(text) if nfc else text
    spaced = F.regexp_replace(F.regexp_replace(text, f"[{LINE_ENDS}]", "\n"), f"[{BLANKS}]+", " ")
    return F.array_join(F.filter(F.transform(F.split(spaced, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def count_words(text: Column, space: str = PYTHON_SPACE) -> Column:
    """Runs of other characters than `space`."""
    return F.size(F.array_remove(F.split(_single_spaced(text, space), " "), ""))


def _single_spaced(text: Column, space: str) -> Column:
    """text with one space for each run of `space`. Single spaces stay as they are; most other characters fail at the first range."""
    blank = rf"[\x{{00}}- \x{{7F}}-\x{{10FFFF}}&&[{space}]]"
    rare = rf"[\x{{00}}-\x{{1F}}\x{{7F}}-\x{{10FFFF}}&&[{space}]]"
    return F.regexp_replace(text, f"{blank}{blank}+|{rare}", " ")


def normalized(text: Column, form: str | None = "NFC") -> Column:
    """What the tokenizer sees: the normal form with single spaces and none at the ends. Name the result in a select of its own
    before it is used several times, as each use works it out anew."""
    return F.trim(_single_spaced(normal_form(text, form) if form else text, WHITE_SPACE))


def pretokens(norm: Column) -> Column:
    """Pre-tokens of a normalised text: words behind a mark, cut in front of each mark; none for an empty text."""
    marked = F.replace(norm, F.lit(" "), F.lit(META))
    led = F.when(F.startswith(marked, F.lit(META)), marked).otherwise(F.concat(F.lit(META), marked))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(led, F.lit("▁[^▁]*"), F.lit(0)))


def _unmarked(norm: Column) -> Column:
    """1 for a text that gets a mark in front, else 0."""
    return ((norm != "") & ~F.startswith(norm, F.lit(META)) & ~F.startswith(norm, F.lit(" "))).cast("int")


def count_pretokens(norm: Column) -> Column:
    """The size of pretokens(), which are as many as their marks."""
    marked = F.replace(norm, F.lit(" "), F.lit(META))
    return F.length(marked) - F.length(F.replace(marked, F.lit(META), F.lit(""))) + _unmarked(norm)


def pretoken_characters(norm: Column) -> Column:
    """The characters of pretokens(): those of the text, and the mark in front."""
    return F.length(norm) + _unmarked(norm)


def bare_pretokens(norm: Column) -> Column:
    """pretokens() without their leading marks: a plain split for texts that hold no mark themselves."""
    marked = F.transform(pretokens(norm), lambda w: F.substring(w, 2, 1 << 30))
    return F.when(norm == "", F.array().cast("array<string>")).when(F.contains(norm, F.lit(META)), marked).otherwise(F.split(norm, " "))


def punctuation_pieces(pretoken: Column) -> Column:
    """Pre-token cut around its runs of punctuation and symbols."""
    return F.regexp_extract_all(pretoken, F.lit(PUNCTUATION_PIECES), F.lit(0))


def hash_residue(title: Column) -> Column:
    """sha1(title) as a number, modulo 10. Powers of 16 are 6 modulo 10, so hex digits before the last count six times."""
    digest = F.sha1(title)
    digits = F.transform(F.split(digest, ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    total = F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0), lambda s, d: s + d)
    last = F.instr(F.lit("0123456789abcdef"), F.right(digest, F.lit(1))) - 1
    return (last + 6 * (total - last)) % 10


def split_name(title: Column) -> Column:
    """heldout for a tenth of the titles, train for the others."""
    return F.when(hash_residue(title) == 0, "heldout").otherwise("train")


def first_sentence(text: Column, max_words: int = 18) -> Column:
    """The first line up to its first sentence end from the sixth word on, or its first max_words words."""
    words = F.filter(F.split(F.split(text, "\n")[0], f"[{PYTHON_SPACE}]+"), lambda w: w != "")
    ends = F.filter(F.transform(words, lambda w, i: F.when((i >= 5) & w.rlike(r"[.\x{964}\x{6D4}?!]$"), i + 1)), lambda i: i.isNotNull())
    return F.array_join(F.slice(words, 1, F.least(F.coalesce(F.get(ends, 0), F.lit(max_words)), F.lit(max_words))), " ")


def unit_hash(word: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the word's MD5."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def url_title(title: Column) -> Column:
    """A page title in a URL: underscores for spaces, everything else percent-encoded."""
    return F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))


def html_escape(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def spoken_list(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def byte_tokens(char: Column) -> Column:
    """<0xNN> for each UTF-8 byte."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(char, "UTF-8")), F.lit(".."), F.lit(0)), lambda b: F.concat(F.lit("<0x"), b, F.lit(">")))


def truncated_ratio(a: Column, b: Column, digits: int) -> Column:
    """a / b with its decimals cut, not rounded, as text; null if b is 0. a and b are non-negative whole numbers."""
    whole = F.call_function("div", a, b)
    rest = (a % b).cast("decimal(38,0)") * F.lit(10**digits).cast("decimal(38,0)")
    scaled = F.call_function("div", rest, b.cast("decimal(38,0)"))
    return F.when(b != 0, F.concat(whole.cast("string"), F.lit("."), F.lpad(scaled.cast("string"), digits, "0")))
