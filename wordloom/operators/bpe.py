"""Byte-pair encoding: learning merges, vocabularies, encoding and decoding.

Spark counts the words; merge learning reads distinct words with counts, one group per configuration, so that sweeps over
configurations run side by side. Counts are encoded by segmenting each distinct word once; texts where they stand, word by word.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from wordloom.functions.text import META, byte_tokens
from wordloom.session import checkpointed

UNKNOWN = "<unk>"


def replaced(symbols: list[str], left: str, right: str) -> list[str]:
    """symbols with each pair (left, right) joined, from the left, without overlaps."""
    out: list[str] = []
    pending = False  # whether the last symbol may still take a partner
    for s in symbols:
        if pending and s == right:
            out[-1] = left + right
            pending = False
        else:
            out.append(s)
            pending = s == left
    return out


def segmented(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols after joining the pair of lowest rank, leftmost first, until no ranked pair is left.

    Places are linked to the neighbours that are left; a heap has the ranked pairs by (rank, place), and those whose symbols have
    changed since are passed over, so that a word of n symbols takes n log n steps.
    """
    n, get = len(symbols), ranks.get
    waiting = [(rank, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := get(pair)) is not None]
    if not waiting:
        return list(symbols)
    heapq.heapify(waiting)
    left: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while waiting:
        _, i, pair = heapq.heappop(waiting)
        j = after[i]
        if j >= n or left[i] != pair[0] or left[j] != pair[1]:
            continue
        left[i], left[j] = pair[0] + pair[1], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := get(both := (left[i], left[k]))) is not None:
                heapq.heappush(waiting, (rank, i, both))
        h = before[i]
        if h >= 0 and (rank := get(both := (left[h], left[i]))) is not None:
            heapq.heappush(waiting, (rank, h, both))
    return [x for x in left if x is not None]


def learned(words: list[tuple[list[str], int]], n_merges: int, least: int = 1, skip: set[str] | None = None) -> list[tuple[str, str, int]]:
    """The first n_merges merges (left, right, count): highest count first, ties by left, then right, in code-point order.

    Learning ends at the first pair whose count is below least. Products in skip are joined but not listed, as their token
    exists already. Counts are exact, whatever their size.
    """
    names: dict[str, int] = {}
    flat = np.array([names.setdefault(x, len(names)) for s, _ in words for x in s], np.int64)
    return next_merges(Symbols(list(names), flat, np.array([len(s) for s, _ in words], np.int64), [int(n) for _, n in words]), n_merges, least, skip)


def next_merges(symbols: Symbols, n_merges: int, least: int, skip: set[str] | None = None, until_known: bool = False) -> list[tuple[str, str, int]]:
    """The merges that symbols give, which they are joined by; until_known stops behind a product that had a symbol already."""
    heap = [(-n, symbols.spelled(key)) for key, n in symbols.count.items()]
    heapq.heapify(heap)
    made: list[tuple[str, str, int]] = []
    while heap and len(made) < n_merges:
        n, (left, right) = heapq.heappop(heap)
        key = symbols.key(left, right)
        if symbols.count.get(key) != -n:
            continue  # pushed before its count changed
        if -n < least:
            break
        if not skip or left + right not in skip:
            made.append((left, right, -n))
        if until_known and left + right in symbols.ids:
            break
        for changed in symbols.join(key):
            heapq.heappush(heap, (-symbols.count[changed], symbols.spelled(changed)))
    return made


class Symbols:
    """All words' symbols end to end in arrays, with links to the neighbours that are left, the count of each pair of
    neighbours and the places where it may start. A join rewrites all places of a pair at once."""

    def __init__(self, names: list[str], flat: np.ndarray, sizes: np.ndarray, weights: list[int]):
        """flat: the symbols of all words, as places in names; sizes and weights: of the words."""
        self.names = list(names)
        self.ids = {name: i for i, name in enumerate(self.names)}
        wide = sum(n * size for size, n in zip(sizes.tolist(), weights, strict=True)) >= 1 << 63  # then Python's integers
        self.symbol = flat.astype(np.int64)
        self.weight = np.repeat(np.array(weights, object if wide else np.int64), sizes)
        n, ends = len(flat), np.cumsum(sizes)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = ends[sizes > 0]
        self.after[full - 1] = -1
        self.before[(ends - sizes)[sizes > 0]] = -1
        self.count: dict[int, int] = {}
        self.places: dict[int, list[np.ndarray]] = defaultdict(list)
        starts = np.flatnonzero(self.after >= 0)
        self._enter(starts)
        for key, total in zip(*self._sums(self._keys(starts), self.weight[starts]), strict=True):
            self.count[key] = total

    def _id(self, name: str) -> int:
        if name not in self.ids:
            self.ids[name] = len(self.names)
            self.names.append(name)
        return self.ids[name]

    def key(self, left: str, right: str) -> int:
        return self.ids[left] << 32 | self.ids[right]

    def spelled(self, key: int) -> tuple[str, str]:
        return self.names[key >> 32], self.names[key & 0xFFFFFFFF]

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return self.symbol[at] << 32 | self.symbol[self.after[at]]

    @staticmethod
    def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], np.int64)
        return keys[first].tolist(), (np.add.reduceat(values[order], first).tolist() if len(first) else [])

    def _enter(self, at: np.ndarray) -> None:
        """Notes where pairs start, by pair."""
        keys = self._keys(at)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        for key, part in zip(keys[first].tolist(), np.split(at, first[1:]) if len(keys) else [], strict=True):
            self.places[key].append(part)

    def join(self, key: int) -> list[int]:
        """Joins a pair, from the left and without overlaps, wherever it stands; the pairs whose count is another now, but for
        those that are gone."""
        left, right = key >> 32, key & 0xFFFFFFFF
        if key not in self.places:
            self._id(self.names[left] + self.names[right])
            return []
        at = np.unique(np.concatenate(self.places.pop(key, [np.array([], np.int64)])))
        at = at[(self.symbol[at] == left) & (self.after[at] >= 0)]
        at = at[self.symbol[self.after[at]] == right]
        if left == right and len(at):  # in a run of equal symbols, every other pair
            chained = np.r_[False, self.after[at[:-1]] == at[1:]]
            start = np.flatnonzero(~chained)
            at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))) % 2 == 0]
        second = self.after[at]
        old = np.unique(np.concatenate([self.before[at], at, second]))
        old = old[(old >= 0) & (self.after[old] >= 0)]
        lost = self._keys(old), -self.weight[old]
        behind = self.after[second]
        self.symbol[at] = self._id(self.names[left] + self.names[right])
        self.symbol[second] = -1
        self.after[at] = behind
        self.before[behind[behind >= 0]] = at[behind >= 0]
        self.after[second] = -1
        fresh = np.unique(np.concatenate([self.before[at], at]))
        fresh = fresh[(fresh >= 0) & (self.after[fresh] >= 0)]
        self._enter(fresh)
        changed = []
        for k, d in zip(*self._sums(np.concatenate([lost[0], self._keys(fresh)]), np.concatenate([lost[1], self.weight[fresh]])), strict=True):
            if d:
                total = self.count.get(k, 0) + d
                if total:
                    self.count[k] = total
                    changed.append(k)
                else:
                    del self.count[k]
        return changed


MERGES = "rank int, left string, right string, n long"


def learn_merges(words: DataFrame, n_merges: int, config: tuple[str, ...] = (), least: int = 1, value: str = "n") -> DataFrame:
    """(*config, rank, left, right, n): merges of each configuration's distinct words (word or symbols, and a whole count).

    A group is one configuration's vocabulary, not its corpus, and holds every word; learning ends at the first pair whose
    count is below least. Configurations run in parallel.
    """
    symbols = F.col("symbols") if "symbols" in words.columns else F.filter(F.split("word", ""), lambda c: c != "")
    narrow = words.select(*config, symbols.alias("symbols"), F.col(value).cast("long").alias("n")).where("n > 0")
    own = [f for f in words.schema.fields if f.name in config]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), MERGES])

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lists = group.column("symbols").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        symbols = Symbols(coded.dictionary.to_pylist(), coded.indices.to_numpy(), sizes, group.column("n").to_pylist())
        made = next_merges(symbols, n_merges, least)
        cols = [pa.array(x, t) for x, t in zip(zip(*((k, *m) for k, m in enumerate(made)), strict=True) if made else ((),) * 4, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)]
        return pa.table([*(pa.array([k.as_py()] * len(made), k.type) for k in key), *cols], names=[*config, "rank", "left", "right", "n"])

    return narrow.groupBy(*config).applyInArrow(run, schema)


def learn_merges_relational(words: DataFrame, n_merges: int, value: str = "n", at_once: int = 32) -> DataFrame:
    """The same merges by DataFrame rounds, for vocabularies that fit no worker; the driver sees at_once pairs per round.

    A round counts the pairs, and takes as many of the highest as are sure to be next: pairs that share no symbol with those
    taken before them, and stay above every pair that those bring about. What a merge of (a, b) brings about is at most as
    frequent as its most frequent neighbourhood (x, a, b) or (a, b, x), which is counted too.
    """
    spark, step = words.sparkSession, lambda c, k: F.slice(c, k + 1, F.greatest(F.size("s") - k, F.lit(0)))
    state = checkpointed(words.select(F.filter(F.split("word", ""), lambda c: c != "").alias("s"), F.col(value).cast("long").alias("n")))
    made: list[tuple[int, str, str, int]] = []
    while len(made) < n_merges:
        pairs = F.filter(F.zip_with("s", step(F.col("s"), 1), lambda a, b: F.struct(a.alias("left"), b.alias("right"))), lambda p: p["right"].isNotNull())
        counts = state.select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))
        top = [tuple(r) for r in counts.orderBy(F.desc("n"), "left", "right").limit(min(at_once, n_merges - len(made))).collect()]
        if not top:
            break
        sure, seen, above = [], set(), -1
        near = _neighbourhoods(state, top) if len(top) > 1 else {}
        for left, right, n in top:
            if sure and (n <= above or left in seen or right in seen):
                break
            sure.append((left, right))
            made.append((len(made), left, right, n))
            seen |= {left, right}
            above = max(above, near.get((left, right), 0))
        merged = F.col("s")
        for left, right in sure:
            merged = joined(merged, F.lit(left), F.lit(right))
        state = checkpointed(state.select(merged.alias("s"), "n"))
    return spark.createDataFrame(made, MERGES)


def _neighbourhoods(state: DataFrame, top: list[tuple[str, str, int]]) -> dict[tuple[str, str], int]:
    """The count of the most frequent three symbols in a row that hold each pair, by pair."""
    spark = state.sparkSession
    few = F.broadcast(spark.createDataFrame([(a, b) for a, b, _ in top], "left string, right string"))
    threes = F.transform(F.sequence(F.lit(1), F.size("s") - 2), lambda i: F.slice("s", i, 3))
    rows = state.where(F.size("s") > 2).select(F.explode(threes).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    sides = F.explode(F.array(*[F.struct(F.col("t")[i].alias("left"), F.col("t")[i + 1].alias("right")) for i in (0, 1)]))
    found = rows.select(sides.alias("p"), "n").select("p.*", "n").join(few, ["left", "right"]).groupBy("left", "right").agg(F.max("n").alias("n"))
    return {(r["left"], r["right"]): r["n"] for r in found.collect()}


def joined(symbols: Column, left: Column, right: Column) -> Column:
    """replaced() as a column: a fold that joins a symbol to the last one."""
    both = F.concat(left, right)

    def step(out: Column, s: Column) -> Column:
        n = F.size(out)
        meets = (n > 0) & (F.element_at(out, F.greatest(n, F.lit(1))) == left) & (s == right)
        return F.when(meets, F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(both))).otherwise(F.concat(out, F.array(s)))

    folded = F.aggregate(symbols, F.array().cast("array<string>"), lambda o, s: F.when(F.size(o) == 0, F.array(s)).otherwise(step(o, s)))
    return F.when(F.array_contains(symbols, left) & F.array_contains(symbols, right), folded).otherwise(symbols)


def akshara_merges(aksharas: list[str]) -> list[tuple[str, str]]:
    """Fixed merges that build each akshara, in their order, by joining its first two parts until one is left.

    Every akshara that is still to come is kept in the parts that the merges so far leave of it. A new merge ranks last, so it
    changes only those that hold its pair side by side, and older merges may then go on from there.
    """
    ranks: dict[tuple[str, str], int] = {}
    parts = [list(a) for a in aksharas]
    holders: dict[tuple[str, str], set[int]] = defaultdict(set)

    def enter(i: int) -> None:
        for pair in zip(parts[i], parts[i][1:]):
            holders[pair].add(i)

    for i in range(len(parts)):
        enter(i)
    for own in parts:
        while len(own) > 1:
            pair = (own[0], own[1])
            ranks[pair] = len(ranks)
            for i in holders.pop(pair):
                parts[i][:] = segmented(parts[i], ranks)
                enter(i)
    return list(ranks)


def vocabulary(base: DataFrame, merges: DataFrame, size: int | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """(id, token, kind, left, right): base (id, token, kind), then the products of fixed merges, then of learned ones in
    rank order. A product that exists already is skipped, and so is its merge; size cuts the list.

    The number of tokens is the vocabulary size, so ids come from one window over it.
    """
    def rows(m: DataFrame, section: int, kind: str) -> DataFrame:
        return m.select(F.lit(section).alias("section"), F.col("rank").cast("long").alias("place"), F.concat("left", "right").alias("token"), F.lit(kind).alias("kind"), "left", "right")

    every = base.select(F.lit(0).alias("section"), F.col("id").alias("place"), "token", "kind", F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))
    if fixed is not None:
        every = every.unionByName(rows(fixed, 1, "akshara"))
    every = every.unionByName(rows(merges, 2, "learned"))
    first = every.groupBy("token").agg(F.min_by(F.struct("section", "place", "kind", "left", "right"), F.struct("section", "place")).alias("f")).select("token", "f.*")
    ids = first.withColumn("id", (F.row_number().over(Window.orderBy("section", "place")) - 1).cast("long"))
    out = ids.select("id", "token", "kind", "left", "right")
    return out if size is None else out.where(F.col("id") < size)


def page(rows: DataFrame, order: str, number: int, size: int = 50) -> DataFrame:
    """Page `number` (from 0) of rows by `order`; a number outside the pages that there are gives the nearest one."""
    last = max(0, (rows.count() - 1) // size)
    return rows.orderBy(order).offset(min(max(0, number), last) * size).limit(size)


def applied(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """segmented() by another route: merges that the word could use one after the other, each wherever it applies."""
    symbols, names = list(symbols), set(symbols)
    for left, right in sorted(ranks, key=ranks.get):
        if left in names and right in names:
            symbols = replaced(symbols, left, right)
            names.add(left + right)
    return symbols


def segment_words(words: DataFrame, merges: list[tuple[str, str]], alphabet: set[str] | None = None, byte_fallback: bool = False, cut=None) -> DataFrame:
    """words (distinct `word`) with `tokens`. Characters outside the alphabet become <unk>, one each, or their bytes.

    The merge table is shared as a broadcast variable; its size is the vocabulary's. cut is segmented, or applied.
    """
    ranks: dict[tuple[str, str], int] = {}
    for pair in merges:
        ranks.setdefault(tuple(pair), len(ranks))
    shared = words.sparkSession.sparkContext.broadcast((ranks, alphabet, byte_fallback))

    @F.pandas_udf(ArrayType(StringType()))
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks, alphabet, bytes_ = shared.value
        for batch in batches:
            yield batch.map(lambda w: None if w is None else encoded_word(w, ranks, alphabet, bytes_, cut or segmented))

    return words.withColumn("tokens", segment("word"))


def encoded_word(word: str, ranks: dict[tuple[str, str], int], alphabet: set[str] | None = None, byte_fallback: bool = False, cut=segmented) -> list[str]:
    symbols: list[str] = []
    for c in word:
        if alphabet is None or c in alphabet:
            symbols.append(c)
        elif byte_fallback:
            symbols += [f"<0x{b:02X}>" for b in c.encode("utf-8")]
        else:
            symbols.append(UNKNOWN)
    return cut(symbols, ranks)


#: Words whose tokens a worker keeps, and words that it cuts at a time, or one text.
KEPT_WORDS, WORDS_AT_ONCE = 1 << 18, 1 << 16


def _few_words(lists: pa.Array, most: int) -> Iterator[pa.Array]:
    """The rows of a batch of lists in stretches of at most `most` elements, or of one row; nothing is copied."""
    ends, at = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield lists.slice(at, to - at)
        at = to


def encoded_lists(batches: Iterator[pa.Array], cut: Callable[[str], list[str]], ids: dict[str, int] | None = None, kept: int = KEPT_WORDS, at_once: int = WORDS_AT_ONCE) -> Iterator[pa.Array]:
    """The lists of words with each word cut; a worker holds what at_once words and the tokens of `kept` different ones take, however
    many different words a batch has."""
    known: dict[str | None, list[str]] = {None: []}
    names: dict[str, str] = {}  # one object per token, as large as the vocabulary
    for lists in (part for batch in batches for part in _few_words(batch, at_once)):
        words = lists.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        if len(known) + len(different) > kept:
            known = {None: []}
        for w in different:
            if w not in known:
                known[w] = [names.setdefault(t, t) for t in cut(w)]
        flat = [t for w in different for t in known[w]]
        made = pa.array(flat, pa.string())
        if ids is not None:
            made = pa.StructArray.from_arrays([made, pa.array([ids[t] for t in flat], pa.int32())], ["token", "id"])
        ends = pa.array(np.cumsum([0, *(len(known[w]) for w in different)]), pa.int32())
        tokens = pa.ListArray.from_arrays(ends, made).take(words.indices)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), tokens, mask=lists.is_null())


def encoded(pieces: Column, merges: list[tuple[str, str]], alphabet: set[str] | None = None, byte_fallback: bool = False, cut=None, ids: dict[str, int] | None = None) -> Column:
    """array<array<string>>: the tokens of each word of pieces, array<string>, where it stands; see segment_words. With ids, each
    token with its number, array<array<struct<token,id>>>, so that one pass gives both.

    A worker cuts each different word of WORDS_AT_ONCE once and keeps the last KEPT_WORDS; no word is shuffled, so a frequent one is
    no hot key. Null lists stay null, null words have no tokens.
    """
    ranks: dict[tuple[str, str], int] = {}
    for pair in merges:
        ranks.setdefault(tuple(pair), len(ranks))
    shared = SparkSession.active().sparkContext.broadcast((ranks, alphabet, byte_fallback, ids))
    one = StringType() if ids is None else StructType().add("token", StringType()).add("id", IntegerType())

    @F.arrow_udf(ArrayType(ArrayType(one)))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, alphabet, bytes_, ids = shared.value
        yield from encoded_lists(batches, lambda w: encoded_word(w, ranks, alphabet, bytes_, cut or segmented), ids)

    return run(pieces)


def decoded(tokens: Column) -> Column:
    """Text of a token list: byte tokens become their characters, marks become spaces, one leading space goes."""
    byte = r"^<0x[0-9A-F]{2}>$"
    hexed = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(byte), F.substring(t, 4, 2)).otherwise(F.hex(F.encode(t, "UTF-8")))), "")
    joined = F.array_join(tokens, "")
    whole = F.when(F.contains(joined, F.lit("<0x")), F.decode(F.unhex(hexed), "UTF-8")).otherwise(joined)
    return F.regexp_replace(F.replace(whole, F.lit(META), F.lit(" ")), "^ ", "")


def flat_tokens(rows: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, word_at, token_at, token, id): one row per token of rows (key, pieces array<array<string>>)."""
    words = rows.select(key, F.posexplode("pieces").alias("word_at", "tokens"))
    tokens = words.select(key, F.col("word_at").cast("long").alias("word_at"), F.posexplode("tokens").alias("token_at", "token"))
    known = F.broadcast(vocab.select("token", "id"))  # as large as the vocabulary
    return tokens.join(known, "token", "left").select(key, "word_at", F.col("token_at").cast("long").alias("token_at"), "token", "id")


__all__ = ["MERGES", "UNKNOWN", "akshara_merges", "byte_tokens", "decoded", "encoded", "encoded_lists", "encoded_word", "flat_tokens", "joined", "learn_merges", "learn_merges_relational", "learned", "next_merges", "replaced", "segment_words", "segmented", "vocabulary"]
