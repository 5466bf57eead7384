"""Ranked lexical search: documents by the weights of the words that they share with a text.

The index holds shards of documents: each task turns what it reads into shards of about SHARD_WORDS words. A shard's documents
are numbered in the order of doc_id; for each of its words it has one row with the posting list, gaps between the numbers and
counts as variable-length bytes. Sums over shards give the statistics of all documents.

A shard is searched document at a time. The cursors of a query's posting lists lie on a heap by the next document of each. A step
takes cursors off the heap while they begin before the end of the shortest run that has been taken, at most RUN postings of
a list; the documents before that end are then complete, as no other list has them. Their scores are summed, those that beat
the least of the best so far enter a result heap of k, and the cursors go back. Equal scores are decided by the document's
number, so by doc_id. The best of the shards are merged by a window per query, of which each task sends on k rows at most.
"""

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.prefix import ranged, with_offsets
from wordloom.session import scratch, slices

#: Words of a shard, beyond which it ends with the document; postings that a step takes of a list at most.
SHARD_WORDS, RUN = 1 << 21, 4096
#: Words of the queries that are searched at a time, and broadcast; further queries follow in blocks.
BLOCK_WORDS = 1 << 18
#: A term is a maximal run of other characters than these, with A-Z lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of each byte of UTF-8: a blank for what separates terms, else itself, in lower case.
_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
_SLICE = 1 << 20


def terms(text: Column) -> Column:
    """array<string> of the distinct terms of text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(PATTERN), 0))


def words(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a bounded stretch at a time."""
    data, at = data.translate(_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + _SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of seven bits, the low ones first and all but the last marked; and where each number ends."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= 1 << bits
    ends = np.cumsum(sizes)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    left, at = values.copy(), ends - sizes
    live = np.arange(len(values))
    while len(live):
        more = sizes[live] > 1
        data[at[live]] = (left[live] & 127) | (more << 7)
        left[live] >>= 7
        at[live] += 1
        sizes[live] -= 1
        live = live[more]
    return data, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of packed()."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first) if len(first) else np.zeros(0, np.int64)


class _Numbers(dict):
    """Numbers terms in the order in which they are met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class _Shard:
    def __init__(self):
        self.number, self.ids, self.lengths, self.met = _Numbers(), [], [], []
        self.size = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        length = 0
        for part in words(data):
            self.met.append(np.fromiter(map(self.number.__getitem__, part), np.int32, len(part)))
            length += len(part)
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.size += length

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """One row of the documents, then the posting lists."""
        lengths = np.array(self.lengths, np.int64)
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        met = np.concatenate(self.met) if self.met else np.zeros(0, np.int32)
        key, count = np.unique((met.astype(np.int64) << 32) | np.repeat(at, lengths), return_counts=True)
        term, doc = key >> 32, key & 0xFFFFFFFF
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        gap = np.diff(doc, prepend=0)
        gap[starts] = doc[starts]
        data, ends = packed(np.stack([gap, count], axis=1).ravel())
        stops = np.append(starts[1:], len(key))
        cut = np.concatenate([[0], ends[2 * stops - 1]]) if len(starts) else np.zeros(1, np.int64)
        whole = pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))
        one = [pa.array([shard]), pa.nulls(1, pa.string()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.nulls(1, pa.binary()), whole, pa.array([lengths[order].tolist()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(one, NAMES)
        names = pa.array(list(self.number), pa.binary()).cast(pa.string())  # by number, as term is
        blobs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
        for a in range(0, len(starts), 10_000):
            n = min(10_000, len(starts) - a)
            some = [pa.array(np.full(n, shard)), names.slice(a, n), pa.array((stops - starts)[a : a + n]), pa.nulls(n, pa.int64()), blobs.slice(a, n), *[pa.nulls(n, pa.list_(pa.int64()))] * 2]
            yield pa.RecordBatch.from_arrays(some, NAMES)


NAMES = ["shard", "term", "n", "n_words", "postings", "ids", "lengths"]


def index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows of the index of docs (doc_id, text): per shard one without a term, with its doc_ids in order (nulls last) and their
    words, n documents with a word and n_words; and per shard and term the posting list of n documents.

    A null text has no words; repeated rows are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in slices(batches, 500):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made.add(doc_id, text.as_py() or b"")
                if made.size >= shard_words or len(made.ids) >= shard_words:
                    yield from made.rows(number)
                    made, number = _Shard(), number + 1
        if made.ids:
            yield from made.rows(number)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return ready.mapInArrow(run, "shard long, term string, n long, n_words long, postings binary, ids array<long>, lengths array<long>")


@dataclass
class Block:
    """queries: their terms; weights: of the terms that some document has; documents, words: of the whole index."""

    queries: list[tuple[int, list[str]]]
    weights: dict[str, int]
    documents: int
    words: int


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def best(lists: list[tuple[int, int]], doc: np.ndarray, gain: np.ndarray, k: int, run: int = RUN) -> list[tuple[int, int]]:
    """(score, document), highest first and then by document, of the k best with a score above 0; lists are the stretches of
    doc, ascending, and gain that each posting list has."""
    cursors = [(int(doc[a]), a, b) for a, b in lists if a < b]
    heapq.heapify(cursors)
    found: list[tuple[int, int]] = []  # (score, -document), the least first
    while cursors:
        lo, end, taken = cursors[0][0], 1 << 62, []
        while cursors and cursors[0][0] < end:
            _, a, b = heapq.heappop(cursors)
            stop = min(a + run, b)
            end = min(end, int(doc[stop - 1]) + 1)
            taken.append((a, stop, b))
        spans = []
        for a, stop, b in taken:
            c = a + int(np.searchsorted(doc[a:stop], end))
            spans.append(slice(a, c))
            if c < b:
                heapq.heappush(cursors, (int(doc[c]), c, b))
        if end - lo <= 8 * sum(span.stop - span.start for span in spans):
            score, names = np.zeros(end - lo, np.int64), range(lo, end)
            for span in spans:  # a list has a document once
                score[doc[span] - lo] += gain[span]
        else:
            names, place = np.unique(np.concatenate([doc[span] for span in spans]), return_inverse=True)
            score = np.zeros(len(names), np.int64)
            np.add.at(score, place, np.concatenate([gain[span] for span in spans]))
        least = found[0][0] if len(found) == k else 0
        better = np.flatnonzero(score > least)
        if len(better) > k:
            better = better[np.lexsort((better, -score[better]))[:k]]
        for at in better.tolist():
            entry = (int(score[at]), -int(names[at]))
            if len(found) < k:
                heapq.heappush(found, entry)
            elif entry > found[0]:
                heapq.heapreplace(found, entry)
    return [(score, -at) for score, at in sorted(found, reverse=True)]


def _shard_best(table: pa.Table, block: Block, k: int) -> pa.Table:
    """The k best of one shard for each query of the block: query, doc_id, score."""
    one = next(i for i, t in enumerate(table["term"].to_pylist()) if t is None)
    ids, lengths = table["ids"][one].as_py(), np.array(table["lengths"][one].as_py(), np.int64)
    lists = table.filter(pa.compute.is_valid(table["term"]))
    sizes = np.array(lists["n"].to_pylist(), np.int64)
    values = unpacked(np.frombuffer(b"".join(lists["postings"].to_pylist()), np.uint8)).reshape(-1, 2)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    total = np.cumsum(values[:, 0])
    doc = total - np.repeat(total[starts] - values[starts, 0], sizes) if len(sizes) else total
    tf = values[:, 1]
    m = 100 - 90 + (90 * lengths * block.documents) // block.words if block.words else lengths
    names = lists["term"].to_pylist()
    gain = np.repeat(np.array([block.weights[t] for t in names], np.int64), sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    where = {t: (int(a), int(b)) for t, a, b in zip(names, starts, stops, strict=True)}
    out = [(query, ids[at], score) for query, own in block.queries for score, at in best([where[t] for t in own if t in where], doc, gain, k)]
    return pa.table({"query": pa.array([r[0] for r in out], pa.int64()), "doc_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.int64())})


def _search(made: DataFrame, block: Block, k: int) -> DataFrame:
    spark = made.sparkSession
    wanted = spark.createDataFrame([(t,) for t in block.weights], "term string")
    shared = spark.sparkContext.broadcast(block)
    lists = made.join(F.broadcast(wanted), "term", "left_semi").select(*NAMES)
    both = lists.unionByName(made.where("term is null"))
    found = both.groupBy("shard").applyInArrow(lambda t: _shard_best(t, shared.value, k), "query long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(made: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, doc_id, score): the k best documents of the index `made` (a written table) for each row of queries (query
    long, unique; terms). Broadcast is a block of queries, of BLOCK_WORDS terms or a single query, and the weights of its
    terms; more queries take a search per block.
    """
    spark = made.sparkSession
    documents, total = made.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    sized = queries.where(F.size("terms") > 0).withColumn("_size", F.size("terms"))
    if (sized.agg(F.sum("_size")).first()[0] or 0) <= BLOCK_WORDS:
        cut, blocks = sized.withColumn("_block", F.lit(0)), 1
    else:
        before = with_offsets(ranged(sized, ["query"]), [], ["query"], F.col("_size"), "_before")
        path = scratch(spark, "blocks")
        before.withColumn("_block", F.floor(F.col("_before") / BLOCK_WORDS)).write.partitionBy("_block").parquet(path)
        cut = spark.read.parquet(path)
        blocks = cut.agg(F.max("_block")).first()[0] + 1
    results = scratch(spark, "found")
    for number in range(blocks):
        own = cut.where(F.col("_block") == number).select("query", "terms")
        asked = [(r["query"], r["terms"]) for r in own.collect()]  # a block
        names = spark.createDataFrame([(t,) for t in sorted({t for _, ts in asked for t in ts})], "term string")
        holding = made.join(F.broadcast(names), "term").groupBy("term").agg(F.sum("n").alias("n")).collect()  # terms of a block
        found = _search(made, Block(asked, {r["term"]: weight(documents, r["n"]) for r in holding}, documents, total), k)
        if blocks == 1:
            return found
        found.write.mode("append").parquet(results)
    return spark.read.parquet(results)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Per row of items (item_id, text) its k best documents with a score above 0: item_id, rank, doc_id, score.

    Null and empty texts have no terms: such documents are never found and count for nothing, such items find nothing. Rows that
    repeat a doc_id are documents of their own, a null doc_id comes after all others of equal score, and rows that repeat an
    item_id are searched each by itself. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path, asked = scratch(spark, "index"), scratch(spark, "items")
    index(docs).write.parquet(path)
    items.select(F.monotonically_increasing_id().alias("query"), "item_id", terms(F.col("text")).alias("terms")).write.parquet(asked)
    queries = spark.read.parquet(asked)
    found = search(spark.read.parquet(path), queries, k)
    return found.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = f"""
WITH words AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{PATTERN}')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
counts AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS MATERIALIZED (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY r),
total AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM total) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts GROUP BY term),
items AS (SELECT q, item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{PATTERN}'))) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
scored AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r) CROSS JOIN total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
