"""Edit-aware token counts: pre-token segment trees per document, re-encoded only where an edit reaches.

A document's text is split into pre-tokens, each of which the byte-level tokenizer encodes on its own. Leaves hold runs of
pre-tokens (their lengths and token counts); inner nodes hold the characters and tokens below. An edit descends by
characters to the first pre-token that it can change, splits the text anew from there until a new boundary meets an old
one behind the edit, replaces the leaves in between and corrects the sums on the way up. Every other count is reused.
"""

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import scratch, slices

LEAF = 64
_CACHED = 1 << 18
#: The word splitting of the byte-level tokenizer file (public, in its format's description). It looks one character
#: ahead at most, and never back.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class _Counts(dict):
    """Tokens of the pre-tokens seen lately."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) < 64:
            if len(self) >= _CACHED:
                self.clear()
            self[piece] = n
        return n


_counters: dict[str, _Counts] = {}


def counter(path: str) -> _Counts:
    """pre-token -> number of tokens; one per worker process and tokenizer file."""
    if path not in _counters:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        settings = json.loads(tokenizer.to_str())
        split = settings["pre_tokenizer"] or {}
        if settings["normalizer"] or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path} does not split words as PRE_TOKEN does")
        tokenizer.encode_special_tokens = True
        _counters[path] = _Counts(lambda piece: len(tokenizer.encode(piece, add_special_tokens=False).ids))
    return _counters[path]


class Tree:
    """Segment tree of one text. lens and counts list each leaf's pre-tokens; sums[0] has a row (characters, tokens) per
    leaf, each further level one per two nodes below."""

    def __init__(self, lens: list[list[int]], counts: list[list[int]]):
        self.lens, self.counts = lens, counts
        self._sum()

    def _sum(self) -> None:
        level = np.array([(sum(a), sum(b)) for a, b in zip(self.lens, self.counts, strict=True)] or [(0, 0)], np.int64)
        self.sums = [level]
        while len(level) > 1:
            level = np.add.reduceat(level, np.arange(0, len(level), 2), axis=0)
            self.sums.append(level)

    @classmethod
    def of(cls, text: str, count: _Counts) -> "Tree":
        pieces = PRE_TOKEN.findall(text)
        lens, counts = list(map(len, pieces)), list(map(count.__getitem__, pieces))
        cut = range(0, len(pieces), LEAF)
        return cls([lens[i : i + LEAF] for i in cut], [counts[i : i + LEAF] for i in cut])

    @property
    def characters(self) -> int:
        return int(self.sums[-1][0][0])

    @property
    def tokens(self) -> int:
        return int(self.sums[-1][0][1])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds character `at`, or the last leaf."""
        node, before = 0, 0
        for level in reversed(self.sums[:-1]):
            node *= 2
            if node + 1 < len(level) and before + level[node][0] <= at:
                before += int(level[node][0])
                node += 1
        return node, before

    def to_bytes(self) -> bytes:
        flat = [np.array([x for leaf in rows for x in leaf], "<u4").tobytes() for rows in (self.lens, self.counts)]
        shape = np.array([len(self.lens), *map(len, self.lens)], "<u4").tobytes()
        return zlib.compress(shape + flat[0] + flat[1], 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Tree":
        values = np.frombuffer(zlib.decompress(data), "<u4").tolist()
        n = values[0]
        shape, rest = values[1 : n + 1], values[n + 1 :]
        half, rows = len(rest) // 2, ([], [])
        for part, out in zip((rest[:half], rest[half:]), rows, strict=True):
            at = 0
            for size in shape:
                out.append(part[at : at + size])
                at += size
        return cls(*rows)

    def edit(self, text: str, start: int, end: int, new: str, count: _Counts) -> tuple[str, int]:
        """Replace text[start:end] by new; text is what the tree counts. Returns the new text and the number of pre-tokens
        that were encoded again."""
        changed = text[:start] + new + text[end:]
        if not self.lens:
            fresh = Tree.of(changed, count)
            self.lens, self.counts, self.sums = fresh.lens, fresh.counts, fresh.sums
            return changed, sum(map(len, self.lens))
        # The first pre-token that the edit can change: one that ends at start - 1 or later, as a match looks one ahead.
        leaf, at = self.find(max(0, start - 1))
        if leaf and at + 1 >= start:
            leaf -= 1
            at -= int(self.sums[0][leaf][0])
        i = 0
        while i < len(self.lens[leaf]) and at + self.lens[leaf][i] + 1 < start:
            at += self.lens[leaf][i]
            i += 1
        first, kept = leaf, i
        # Old boundaries behind the edit, in new positions; new matches run until they meet one.
        shift, old, j = len(new) - (end - start), at, i
        pieces, here, stop = [], at, start + len(new)
        for match in PRE_TOKEN.finditer(changed, at):
            while leaf < len(self.lens) and old + shift < here:
                if j == len(self.lens[leaf]):
                    leaf, j = leaf + 1, 0
                else:
                    old += self.lens[leaf][j]
                    j += 1
            if here >= stop and old >= end and old + shift == here:
                break
            pieces.append(match[0])
            here = match.end()
        else:
            leaf, j = len(self.lens) - 1, len(self.lens[-1])
        if leaf == len(self.lens):
            leaf, j = leaf - 1, len(self.lens[-1])
        lens = self.lens[first][:kept] + list(map(len, pieces)) + self.lens[leaf][j:]
        counts = self.counts[first][:kept] + list(map(count.__getitem__, pieces)) + self.counts[leaf][j:]
        if first == leaf and 0 < len(lens) <= 2 * LEAF:
            self.lens[leaf], self.counts[leaf] = lens, counts
            difference = np.array([sum(lens), sum(counts)]) - self.sums[0][leaf]
            node = leaf
            for level in self.sums:
                level[node] += difference
                node //= 2
        else:
            cut = range(0, len(lens), LEAF)
            self.lens[first : leaf + 1] = [lens[k : k + LEAF] for k in cut]
            self.counts[first : leaf + 1] = [counts[k : k + LEAF] for k in cut]
            self._sum()
        return changed, len(pieces)


def _mapped(docs: DataFrame, made: list[tuple[str, pa.DataType, str]], run) -> DataFrame:
    """docs with further columns in front; run(row values by name) gives them."""
    names = docs.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(it, 512):
            rows = [run(dict(zip(names, row, strict=True))) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            cols = [pa.array([r[k] for r in rows], t) for k, (_, t, _) in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*cols, *part.columns], [*(m[0] for m in made), *names])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(batches, ", ".join([*(f"`{n}` {s}" for n, _, s in made), *own]))


def build_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(tree, n_tokens) in front of docs' columns, which hold text; a null text counts as empty."""

    def run(row: dict) -> tuple:
        tree = Tree.of(row["text"] or "", counter(tokenizer_path))
        return tree.to_bytes(), tree.tokens

    return _mapped(docs, [("tree", pa.binary(), "binary"), ("n_tokens", pa.int64(), "long")], run)


def apply_edits(trees: DataFrame, tokenizer_path: str, made: tuple[str, ...] = ("new_text", "new_tree", "new_n_tokens", "n_reencoded")) -> DataFrame:
    """(new_text, new_tree, new_n_tokens, n_reencoded), or those of them in `made`, in front of trees' columns, which are text,
    tree and edits, an array<struct<start,length,replacement>> that is applied in its order, each edit to the text that the
    last one left.

    Positions are code points and are cut to the text; null edits, null members and null replacements (nothing) are allowed.
    """

    def run(row: dict) -> tuple:
        text, tree, again, count = row["text"] or "", Tree.from_bytes(row["tree"]), 0, counter(tokenizer_path)
        for edit in row["edits"] or []:
            if edit is None:
                continue
            start = min(max(0, edit["start"] or 0), len(text))
            end = min(len(text), start + max(0, edit["length"] or 0))
            text, n = tree.edit(text, start, end, edit["replacement"] or "", count)
            again += n
        out = {"new_text": text, "new_n_tokens": tree.tokens, "n_reencoded": again}
        return tuple(tree.to_bytes() if c == "new_tree" else out[c] for c in made)

    types = {"new_text": (pa.string(), "string"), "new_tree": (pa.binary(), "binary"), "new_n_tokens": (pa.int64(), "long"), "n_reencoded": (pa.int64(), "long")}
    return _mapped(trees, [(c, *types[c]) for c in made], run)


def revision(text: Column, doc_id: Column) -> Column:
    """Three edits of any text, the same ones every time: words put in at a third, a stretch cut out at two thirds, a
    piece replaced at the start, with lengths that follow from doc_id."""
    n, k = F.length(text), F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1))), F.lit(23)).cast("int")

    def edit(start: Column, length: Column, replacement: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), replacement.alias("replacement"))

    return F.array(
        edit(F.floor(n * 2 / 3), k, F.lit("")),
        edit(F.floor(n / 3), F.lit(0), F.concat(F.lit(" as revised, part "), k.cast("string"), F.lit("'s "))),
        edit(k, F.lit(1), F.lit(" \n ")),
    )


def edited_token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_reencoded for each row of docs: tokens before and after `revision`, and the
    pre-tokens that had to be encoded again for it.

    The trees are kept: they are written with the texts they count, as a corpus keeps them, and read back when the edits
    arrive. A null text counts as empty. Null ids and repeated rows stay, an empty table gives no rows, other columns are
    not read, texts of any length are counted whole.
    """
    path = scratch(docs.sparkSession, "trees")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    build_trees(rows, tokenizer_path).write.option("compression", "zstd").parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    made = apply_edits(kept.withColumn("edits", revision(F.col("text"), F.col("doc_id"))), tokenizer_path, ("new_n_tokens", "n_reencoded"))
    return made.select("doc_id", "n_tokens", F.col("new_n_tokens").alias("n_tokens_edited"), "n_reencoded")
