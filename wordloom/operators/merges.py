"""Merge learning over a vocabulary that lies in many tasks, merge by merge equal to learning it in one.

Words are rows (symbols as numbers, count) of a table that is rewritten once a round. A round makes all merges whose count
reaches a threshold T:

1. Pairs of neighbours are counted: by each task over the words that it holds, then over the tasks. The candidates are the most
   frequent pairs, T is the least count among them.
2. Each word is cut into runs of neighbours that are candidates, and equal runs are summed. A pair that comes to reach T during
   the round consists of symbols whose inner ends were neighbours before, and these neighbours were at least as frequent: a
   candidate. So all its places lie inside runs, and the runs, which are short and far fewer than words, decide every merge
   down to T, counts included. They are what the driver learns from, by the learner for one task.
3. The tasks make the same merges in the same order in their words, and count the pairs again.

The argument needs a symbol to have one spelling by the symbols at the round's beginning. A product that exists already ends
the round. If more pairs than may be candidates share the highest count, the first of them by spelling is the round's only
merge, which is right for any counts. If there are too many runs, the candidates are quartered; the runs of a single pair are as
few as the lengths of words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.bpe import MERGES, Symbols, next_merges
from wordloom.session import dropped, scratch

#: Pairs that may be candidates, and different runs that the driver learns from, in a round.
CANDIDATES, RUNS = 4096, 1 << 17
_FIRST = 64
#: Symbols that a task holds at a time.
CHUNK = 1 << 18
_LOW = (1 << 32) - 1


class _Chunks:
    """Batches (symbols array<int>, n long) gathered to chunks of numpy arrays: symbols end to end, sizes and counts of words."""

    def __init__(self, batches: Iterator[pa.RecordBatch], column: int = 0):
        self.batches, self.column = batches, column

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in self.batches:
            lists = batch.column(self.column)
            held.append((lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()), batch.column(self.column + 1).to_numpy(zero_copy_only=False)))
            size += len(held[-1][0])
            if size >= CHUNK:
                whole, held, size = tuple(map(np.concatenate, zip(*held))), [], 0
                yield whole
                del whole
        if held:
            yield tuple(map(np.concatenate, zip(*held)))


def _halves(totals: list[int]) -> list[pa.Array]:
    """Whole numbers of any size as two columns, so that sums of them fit."""
    return [pa.array([x & _LOW for x in totals], pa.int64()), pa.array([x >> 32 for x in totals], pa.int64())]


def _whole(low: str = "low", high: str = "high"):
    return (F.sum(F.col(high)).cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.sum(F.col(low))).cast("decimal(38,0)")


_STATE = "s array<int>, n long, key long, low long, high long"
_NAMES = ["s", "n", "key", "low", "high"]


def _row_batches(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), rows):
        b = min(a + rows, len(sizes))
        lists = pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), pa.array(flat[ends[a] : ends[b]], pa.int32()))
        yield pa.RecordBatch.from_arrays([lists, pa.array(weights[a:b], pa.int64()), *[pa.nulls(b - a, pa.int64())] * 3], _NAMES)


def _merged(batches: Iterator[pa.RecordBatch], names: list[str], merges: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """The words after the merges, those of a single symbol left out, and the counts of their pairs by chunk."""
    for chunk in _Chunks(batches):
        yield from _merged_chunk(*chunk, names, merges)
        del chunk  # before the next one is gathered


def _merged_chunk(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, names: list[str], merges: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    made = Symbols(names, flat, sizes, weights.tolist())
    for left, right in merges:
        made.join(made.key(left, right))
    word, live = np.repeat(np.arange(len(sizes)), sizes), made.symbol >= 0
    left = np.bincount(word[live], minlength=len(sizes))
    keep = left > 1
    yield from _row_batches(made.symbol[live & keep[word]], left[keep], weights[keep])
    keys = list(made.count)
    for a in range(0, len(keys), 50_000):
        some = keys[a : a + 50_000]
        nothing = [pa.nulls(len(some), pa.list_(pa.int32())), pa.nulls(len(some), pa.int64())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(some, pa.int64()), *_halves([int(made.count[k]) for k in some])], _NAMES)


def runs_of(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, candidates: np.ndarray) -> dict[bytes, int]:
    """The counts of the longest runs of two symbols or more whose neighbours are all candidates (sorted keys, left << 32 |
    right); a run is its symbols as 32-bit numbers."""
    keys = flat[:-1] << 32 | flat[1:]
    at = np.minimum(np.searchsorted(candidates, keys), len(candidates) - 1)
    linked = np.concatenate([[False], candidates[at] == keys, [False]])
    linked[np.cumsum(sizes)] = linked[0] = False  # no run goes on to the next word
    starts, ends = np.flatnonzero(linked[1:] & ~linked[:-1]), np.flatnonzero(linked[:-1] & ~linked[1:])
    own = np.repeat(np.arange(len(sizes)), sizes)[starts]
    data, out = flat.astype("<i4").tobytes(), defaultdict(int)
    for a, b, n in zip((4 * starts).tolist(), (4 * ends + 4).tolist(), weights[own].tolist(), strict=True):
        out[data[a:b]] += n
    return out


def _runs(words: DataFrame, candidates: np.ndarray) -> DataFrame:
    """(run, n) of the words of the table."""
    shared = words.sparkSession.sparkContext.broadcast(np.sort(candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, sizes, weights in _Chunks(batches):
            found = runs_of(flat, sizes, weights, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *_halves(list(found.values()))], ["run", "low", "high"])

    return words.select("s", "n").mapInArrow(run, "run binary, low long, high long").groupBy("run").agg(_whole().alias("n"))


def _first(pairs: DataFrame, n: int, names: list[str]) -> int:
    """The key of the first pair by spelling of those with count n."""
    known = F.broadcast(pairs.sparkSession.createDataFrame(list(enumerate(names)), "id long, name string"))  # the vocabulary
    left, right = known.select(F.col("id").alias("_l"), F.col("name").alias("left")), known.select(F.col("id").alias("_r"), F.col("name").alias("right"))
    tied = pairs.where(F.col("n") == F.lit(str(n)).cast("decimal(38,0)")).withColumn("_l", F.shiftright("key", 32)).withColumn("_r", F.col("key").bitwiseAND(F.lit(_LOW)))
    return tied.join(left, "_l").join(right, "_r").orderBy("left", "right").select("key").first()[0]


def learn_merges_partitioned(words: DataFrame, n_merges: int, least: int = 1, value: str = "n", candidates: int = CANDIDATES, runs: int = RUNS, rounds: list[int] | None = None) -> DataFrame:
    """(rank, left, right, n): the merges of distinct words (word or symbols, and a whole count), as learn_merges gives them.

    A task holds CHUNK symbols at a time; the driver holds the vocabulary, `candidates` pairs and `runs` runs of at most a word's
    length. Each count fits 64 bits, sums have 38 digits. Learning ends at the first pair whose count is below least. Null words and
    counts under one count for nothing. rounds takes the number of merges of each round.
    """
    spark = words.sparkSession
    symbols = F.col("symbols") if "symbols" in words.columns else F.filter(F.split("word", ""), lambda c: c != "")
    given, tasks = scratch(spark, "words"), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words.select(symbols.alias("s"), F.col(value).cast("long").alias("n")).where("n > 0 and size(s) > 0").repartition(tasks).write.parquet(given)
    narrow = spark.read.parquet(given)
    names = sorted(r[0] for r in narrow.select(F.explode("s")).distinct().collect())  # an alphabet
    shared = spark.sparkContext.broadcast({name: i for i, name in enumerate(names)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            coded = lists.flatten().dictionary_encode()
            number = np.array([shared.value[x] for x in coded.dictionary.to_pylist()] + [0], np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32()), pa.array(number[coded.indices.to_numpy()], pa.int32())), batch.column(1)], ["s", "n"])

    state, before, known, width = narrow.mapInArrow(numbered, "s array<int>, n long"), given, set(names), min(candidates, _FIRST)
    made: list[tuple[str, str, int]] = []
    fresh: list[tuple[str, str]] = []
    while len(made) < n_merges:
        path, last = scratch(spark, "merges"), spark.sparkContext.broadcast((list(names), list(fresh)))
        state.mapInArrow(lambda batches, last=last: _merged(batches, *last.value), _STATE).write.parquet(path)
        dropped(spark, before)
        before, table = path, spark.read.parquet(path)
        for product in (left + right for left, right in fresh):
            if product not in known:
                known.add(product)
                names.append(product)
        state = table.where("key is null").select("s", "n")
        pairs = table.where("key is not null").groupBy("key").agg(_whole().alias("n"))
        top = [(r["key"], int(r["n"])) for r in pairs.orderBy(F.desc("n")).limit(candidates + 1).collect()]
        if not top or top[0][1] < least:
            break
        found, width = _round(state, pairs, top, names, n_merges - len(made), least, width, candidates, runs)
        made, fresh = made + found, [(left, right) for left, right, _ in found]
        if rounds is not None:
            rounds.append(len(fresh))
        if not fresh:
            break
    dropped(spark, before)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(made)], MERGES)


def learn_merges_by(words: DataFrame, n_merges: int, key: str, least: int = 1, value: str = "n", at_once: int = 4) -> DataFrame:
    """(key, rank, left, right, n): the merges of each key's words, as learn_merges gives them by configuration. Every vocabulary
    lies in all tasks, at_once of them side by side; keys are few, and null is one."""
    spark, field = words.sparkSession, words.schema[key]

    def learned(x) -> list[tuple]:
        made = learn_merges_partitioned(words.where(F.col(key).eqNullSafe(F.lit(x).cast(field.dataType))).drop(key), n_merges, least, value)
        return [(x, *r) for r in made.collect()]  # merges of a vocabulary

    with ThreadPoolExecutor(at_once) as pool:
        rows = [r for part in pool.map(learned, [r[0] for r in words.select(key).distinct().collect()]) for r in part]
    return spark.createDataFrame(rows, f"`{key}` {field.dataType.simpleString()}, {MERGES}")


def _round(state: DataFrame, pairs: DataFrame, top: list[tuple[int, int]], names: list[str], room: int, least: int, width: int, most: int, runs: int) -> tuple[list[tuple[str, str, int]], int]:
    """The merges of a round with their counts, and how many candidates the next round may begin with: four times as many, if
    the runs were few."""
    candidates = most
    while True:
        threshold = max(least, top[width][1] + 1) if len(top) > width else least
        keys = [key for key, n in top[:width] if n >= threshold]
        if not keys and width < candidates:  # more pairs share the highest count
            width = min(candidates, 4 * width)
            continue
        alone = not keys
        if alone:
            threshold, keys = top[0][1], [_first(pairs, top[0][1], names)]
        found = _runs(state, np.array(keys, np.int64)).limit(runs + 1 if len(keys) > 1 else 1 << 30).toArrow()
        if len(found) <= runs or len(keys) == 1:
            break
        width = len(keys) // 4 or 1
        if top[width][1] == top[0][1]:  # nor can fewer be told apart: one of them by itself
            candidates = width
    flat = [np.frombuffer(x, "<i4") for x in found["run"].to_pylist()]
    symbols = Symbols(names, np.concatenate(flat), np.array([len(x) for x in flat], np.int64), [int(n) for n in found["n"].to_pylist()])
    return next_merges(symbols, 1 if alone else room, threshold, until_known=True), min(most, 4 * width) if 8 * len(found) < runs else width
