"""Packing by multiway differencing: near-equal windows that are then filled to the brim.

Each task encodes the texts that it reads and packs them group by group, about GROUP_WINDOWS windows at a time, while their ids
are at hand: nothing is shuffled, and a group depends on no other. Documents longer than a window give whole windows first.
The rest of a group is dealt to k windows by Karmarkar-Karp differencing. Each document begins as a partial partition with one
filled window and k - 1 empty ones; the two partitions of largest imbalance are merged, the fullest windows of the one with the
emptiest of the other, until a single partition is left. If its fullest window exceeds the capacity, k rises and the differencing
starts again; with a window for each document it must end.

What rising has cost is taken back: as many windows as all gaps make up are dissolved, those of the fewest documents, and their
ids fill the gaps of the others, so that only the few documents of dissolved windows are cut. What is left of them, less than a
window, goes into sequences of a power of two, which need no padding either.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.packing import encoder
from wordloom.session import slices

CAPACITY = 4096
END_ID = 2
GROUP_WINDOWS = 256
#: A task's sequences are numbered from its own multiple of this.
_OWN = 1 << 40


@dataclass
class Partial:
    """A partition of some items into windows: how far each window is above the emptiest, largest first, without empty windows,
    and the node of its items."""

    sums: np.ndarray
    nodes: np.ndarray


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each item; the sums of the windows are near-equal."""
    n = len(sizes)
    heap = [(-int(size), at, Partial(np.array([size], np.int64), np.array([at], np.int64))) for at, size in enumerate(sizes)]
    heapq.heapify(heap)
    joined: list[tuple[int, np.ndarray, np.ndarray]] = []  # first new node, and the pairs of nodes that became one window
    made = n
    for turn in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[2], heap[0][2]
        alone = min(k - len(b.sums), len(a.sums))  # windows of a that meet empty ones of b
        both = len(a.sums) - alone
        if both:
            joined.append((made, a.nodes[alone:], b.nodes[::-1][:both]))
        sums = np.concatenate([a.sums[:alone], a.sums[alone:] + b.sums[::-1][:both], b.sums[::-1][both:]])
        nodes = np.concatenate([a.nodes[:alone], np.arange(made, made + both), b.nodes[::-1][both:]])
        made += both
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heapreplace(heap, (-int(sums[0]), turn, Partial(sums, nodes)))
    window = np.zeros(made, np.int64)
    if n:
        nodes = heap[0][2].nodes
        window[nodes] = np.arange(len(nodes))
    for first, left, right in reversed(joined):
        window[left] = window[right] = window[first : first + len(left)]
    return window[:n]


def near_equal(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and the number of windows: the least whole number that could do, raised while a window exceeds
    the capacity, first by what the excess of the fullest asks for and then in doubling steps."""
    total = int(sizes.sum())
    k, step = -(-total // capacity), 0
    while True:
        window = differenced(sizes, k)
        over = int(np.bincount(window, sizes, k).max(initial=0)) - capacity
        if over <= 0:
            return window, k
        step = max(2 * step, 1, -(-k * over // capacity) if not step else 0)
        k = min(k + step, len(sizes))


def filled(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, to): each is as long as the capacity or a power of two, and each place of each item is in
    exactly one. Items are from 1 to the capacity."""
    window, k = near_equal(sizes, capacity)
    order = np.argsort(window, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(window, minlength=k))[:-1]) if k else []
    sums = [int(sizes[m].sum()) for m in members]
    dissolved = -(-sum(capacity - s for s in sums) // capacity)
    by_count = sorted(range(k), key=lambda w: (len(members[w]), w))
    spare = [(int(i), 0, int(sizes[i])) for w in by_count[:dissolved] for i in members[w]][::-1]

    def taken(n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            item, a, b = spare.pop()
            if b - a > n:
                spare.append((item, a + n, b))
                b = a + n
            out.append((item, a, b))
            n -= b - a
        return out

    out = [[(int(i), 0, int(sizes[i])) for i in members[w]] + taken(capacity - sums[w]) for w in sorted(by_count[dissolved:])]
    left = sum(b - a for _, a, b in spare)
    while left:
        power = 1 << (left.bit_length() - 1)
        out.append(taken(power))
        left -= power
    return out


class _Group:
    """What a task has read and not yet packed: ends of documents, at most a capacity each."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.number = capacity, first
        self.ends: list[tuple[int | None, int, bytes, int]] = []  # doc_id, start, ids, tokens of the document
        self.tokens = 0

    def add(self, doc_id: int | None, data: bytes) -> Iterator[tuple]:
        """Rows of the whole windows of a document; the rest of it waits."""
        size, step = len(data) // 4, 4 * self.capacity
        for at in range(0, len(data), step):
            part = data[at : at + step]
            if len(part) == step:
                yield doc_id, at // 4, self.capacity, part, size, self.number, 0
                self.number += 1
            else:
                self.ends.append((doc_id, at // 4, part, size))
                self.tokens += len(part) // 4

    def packed(self) -> Iterator[tuple]:
        sizes = np.array([len(part) // 4 for _, _, part, _ in self.ends], np.int64)
        for sequence in filled(sizes, self.capacity):
            offset = 0
            for item, a, b in sequence:
                doc_id, start, part, size = self.ends[item]
                yield doc_id, start + a, b - a, part[4 * a : 4 * b], size, self.number, offset
                offset += b - a
            self.number += 1
        self.ends, self.tokens = [], 0


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def near_equal_windows(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (its place there). A document is the ids of its text and end_id.

    Each sequence has as many ids as the capacity or a power of two. A null or empty text is the end id alone; very long texts
    give whole windows and one rest; repeated rows are packed as often as they occur; a null id stays null; an empty table
    gives no rows; columns other than doc_id and text are not read. Sequences depend on how rows lie in partitions, and a
    partition that is worked out again gets the same ones.
    """
    if capacity < 1:
        raise ValueError("a sequence has at least one place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).many, end_id.to_bytes(4, "little")
        group, rows, held = _Group(capacity, TaskContext.get().partitionId() * _OWN), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)

        for part in (piece for b in batches for piece in slices([b], 500)):
            texts = (x.as_py() or "" for x in part.column(1))
            for doc_id, data in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                for row in group.add(doc_id, data + end):
                    rows.append(row)
                    held += capacity
                    if held >= group_windows * capacity:
                        yield batch()
                        rows, held = [], 0
                if group.tokens >= group_windows * capacity:
                    rows += group.packed()
                    yield batch()
                    rows, held = [], 0
        rows += group.packed()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def differencing_packing(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """near_equal_windows with the checksum of the ids in their place."""
    made = near_equal_windows(docs, tokenizer_path)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
