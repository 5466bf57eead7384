"""Text of HTML pages: all text with built-in functions, prose with the standard library's parser."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wordloom.functions.text import clean_text

#: Named character references that pages use most.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))
#: What prose leaves out, as (element or nothing, class or nothing), and what it takes.
DROPPED = (
    ("style", ""),
    ("script", ""),
    ("sup", "reference"),
    ("", "mw-editsection"),
    ("table", ""),
    ("figure", ""),
    ("", "thumb"),
    ("", "navbox"),
    ("", "reflist"),
    ("ol", "references"),
    ("", "infobox"),
    ("", "metadata"),
    ("", "mw-empty-elt"),
    ("", "noprint"),
    ("", "gallery"),
    ("math", ""),
    ("", "mwe-math-element"),
)
PROSE_TAGS = ("p", "li", "h2", "h3", "h4", "h5")
ROOT_CLASS = "mw-parser-output"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def html_all(html: Column, nfc: bool = True) -> Column:
    """Every text node but those of scripts, styles and comments, one per line, cleaned.

    Pages with an element of ROOT_CLASS give that element's text only; finding its end takes the parser, which other
    pages are not sent to.
    """
    body = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "\n")
    text = F.regexp_replace(body, r"<[^>]*>", "\n")
    return clean_text(F.coalesce(_rooted(F.when(F.contains(html, F.lit(ROOT_CLASS)), html)), unescaped(text)), nfc)


def unescaped(text: Column) -> Column:
    """text with all character references replaced, by the HTML standard's rules: built-in functions where ENTITIES are the only
    references, the standard library where there may be others."""
    known = "|".join(name[1:] for name, _ in ENTITIES)
    plain = text
    for name, char in ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    other = text.rlike(f"&(?!(?:{known}))[#A-Za-z]") | text.rlike("&amp;[#A-Za-z]")
    return F.coalesce(_unescaped(F.when(other, text)), plain)


def links(html: Column) -> Column:
    """array<string> of link targets, in order; names of elements and attributes in any case."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref=[\"']([^\"']*)[\"']"), F.lit(1))


class _Reader(HTMLParser):
    """Walks a page once. prose collects the text of PROSE_TAGS: paragraphs and headings inside a list item belong to it,
    nested items count for themselves and for the item around them. nodes collects every text node that is not in a
    script or style. With a root, only what lies in the first element of ROOT_CLASS counts."""

    def __init__(self, rooted: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int | None]] = []  # tag, dropped, index of its own text
        self.prose: list[list[str]] = []
        self.nodes: list[str] = []
        self.root = 0 if not rooted else None  # depth from which things count; -1 when the root has closed

    def counts(self) -> bool:
        return self.root is not None and self.root >= 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        dropped = bool(self.open and self.open[-1][1]) or any((not t or t == tag) and (not c or c in classes) for t, c in DROPPED)
        own = None
        if self.counts() and tag in PROSE_TAGS and not dropped and (tag == "li" or all(t != "li" for t, _, _ in self.open)):
            own = len(self.prose)
            self.prose.append([])
        self.open.append((tag, dropped, own))
        if self.root is None and ROOT_CLASS in classes:
            self.root = len(self.open)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                if self.root and self.root > len(self.open):
                    self.root = -1
                return

    def handle_data(self, data):
        if not self.counts() or any(t in ("script", "style") for t, _, _ in self.open):
            return
        self.nodes.append(data)
        if not (self.open and self.open[-1][1]):
            for _, _, own in self.open:
                if own is not None:
                    self.prose[own].append(data)


def read_page(html: str) -> _Reader:
    reader = _Reader(ROOT_CLASS in html)
    reader.feed(html)
    reader.close()
    if reader.root is None:  # the name stood in no class
        reader = _Reader(False)
        reader.feed(html)
        reader.close()
    return reader


def prose_of(html: str) -> str:
    return "\n".join("".join(t) for t in read_page(html).prose)


@F.pandas_udf(StringType())
def _prose(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: None if x is None else prose_of(x))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unescape(x))


@F.pandas_udf(StringType())
def _rooted(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: None if x is None else "\n".join(read_page(x).nodes))


def html_prose(html: Column, nfc: bool = True) -> Column:
    """Paragraphs, list items and headings outside of dropped parts, one per line, cleaned."""
    return clean_text(_prose(html), nfc)
