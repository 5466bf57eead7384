"""Best-fit packing planned over a histogram of lengths.

Texts are encoded where they lie and cut into pieces; only (id, piece, start, length, checksum) goes on. The driver gets
the histogram, one count per length up to the capacity, and plans best-fit decreasing over the counts: all sequences with
equal contents form one group, so the plan has a bounded size whatever the number of documents. Pieces then take the
planned places by their rank within their length.
"""

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.prefix import with_offsets
from wordloom.session import checkpointed, slices

CAPACITY = 2048
END_ID = 0
_CACHED = 1 << 19
#: Characters of text that are cut into pieces at a time.
_RUN = 1 << 20
#: The word splitting of the tokenizer file, restricted to characters for which lower-casing and Unicode normal form are
#: plain: ASCII and the Latin-1 letters. Anything else is encoded by the library as a whole.
_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _splits_alike(settings: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops blanks and splits words as _PIECES does, and marks the ends of words."""
    normal = [(x.get("type"), x.get("pattern"), x.get("content")) for x in (settings["normalizer"] or {}).get("normalizers", [])]
    split = [(x.get("type"), x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in (settings["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return (
        normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and split == [("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        and bool(settings["model"].get("end_of_word_suffix"))
        and all("<|" in x["content"] for x in settings["added_tokens"])
    )


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes; equal to encoding each whole text with the library.

    Ids of the pieces seen lately are kept. New pieces of a run of texts are encoded in one call, with blanks between
    them: the tokenizer drops blanks, and the last token of a piece shows by its suffix where the piece ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.split = _splits_alike(settings)
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        pieces = list(new)
        data = self._library(" ".join(pieces))
        stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1)).tolist()
        self.known.update(zip(pieces, [data[a:b] for a, b in zip([0, *stops], stops)], strict=True))

    def _run(self, texts: list[str]) -> list[bytes]:
        cut = [_PIECES.findall(x.lower()) if self.split and _PLAIN.fullmatch(x) and "<|" not in x else None for x in texts]
        seen = {piece for pieces in cut if pieces for piece in pieces}
        new = seen.difference(self.known)
        if len(self.known) + len(new) > _CACHED:
            self.known.clear()
            new = seen
        if new:
            self._learn(new)
        known = self.known.__getitem__
        return [self._library(x) if pieces is None else b"".join(map(known, pieces)) for x, pieces in zip(texts, cut, strict=True)]

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= _RUN:
                yield from self._run(run)
                run, size = [], 0
        if run:
            yield from self._run(run)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and END_ID, cut at the capacity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).many, END_ID.to_bytes(4, "little")
        for batch in slices(batches):
            ids, nth, start, length, crc = [], [], [], [], []
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc_id, data in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    ids.append(doc_id)
                    nth.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            cols = [pa.array(ids, pa.int64()), pa.array(nth, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Group:
    """`count` sequences with equal contents; places are (length, first rank, copies in each sequence, offset)."""

    count: int
    places: list[tuple[int, int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> "Group":
        """Cuts off the first n sequences."""
        first = Group(n, list(self.places))
        self.places = [(size, rank + n * copies, copies, at) for size, rank, copies, at in self.places]
        self.count -= n
        return first


@dataclass
class Plan:
    """Places sorted by (length, first rank): the piece of rank r there is copy (r - rank) % copies of sequence
    first + (r - rank) // copies, at offset + copy * length."""

    length: np.ndarray
    rank: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.int64(1) << np.int64(48)
        at = np.searchsorted(self.length * shift + self.rank, length * shift + rank, side="right") - 1
        within = rank - self.rank[at]
        return self.first[at] + within // self.copies[at], self.offset[at] + within % self.copies[at] * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over counts per length. At most three groups arise per length and a sequence has at most
    sqrt(2 * capacity) distinct lengths, so the plan has under 3 * capacity * sqrt(2 * capacity) places: 400,000 for 2048."""
    room: dict[int, list[Group]] = {}  # by what is left in each sequence
    for size in sorted(histogram, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} is outside 1 to {capacity}")
        left, rank = histogram[size], 0
        for free in range(size, capacity):  # tightest first; what they become is tighter still, and too small or next
            while left and room.get(free):
                group, copies = room[free].pop(), min(free // size, left)
                n = min(group.count, left // copies)
                if n < group.count:
                    room[free].append(group)
                    group = group.split(n)
                group.places.append((size, rank, copies, capacity - free))
                rank, left = rank + n * copies, left - n * copies
                room.setdefault(free - copies * size, []).append(group)
        if left:
            each = capacity // size
            for n, copies in ((left // each, each), (1, left % each)):
                if n and copies:
                    room.setdefault(capacity - copies * size, []).append(Group(n, [(size, rank, copies, 0)]))
                    rank += n * copies
    first, rows = 0, []
    for free in sorted(room):
        for group in room[free]:
            rows += [(size, rank, copies, first, at) for size, rank, copies, at in group.places]
            first += group.count
    made = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*made.T, sequences=first)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, length and further columns) with sequence_id and offset. Reads cut once; the only data on the
    driver is the histogram, and what is broadcast is the plan, whose size is bounded by the capacity.

    Lengths are from 1 to the capacity, else ValueError. Null ids and repeated rows are packed like any other, equal ones in any
    order; an empty table gives no rows; columns must not be named _chunk or _rank.
    """
    ready = checkpointed(cut.withColumn("_chunk", F.spark_partition_id()))
    histogram = {r["length"]: r["n"] for r in ready.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = ready.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    ranked = with_offsets(ready, ["length"], ["doc_id", "piece", "ids_crc32"] if "ids_crc32" in ready.columns else ["doc_id", "piece"], F.lit(1), "_rank").drop("_chunk")
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = shared.value.place(length, rank)
            keep = [k for k, c in enumerate(names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sequence), pa.array(offset)], [*(names[k] for k in keep), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; very long texts are cut into as many pieces as they need. Repeated rows are
    packed as often as they occur, equal ones in any order; a null id stays null; an empty table gives no rows; other
    columns are not read.
    """
    return pack(pieces(docs, tokenizer_path, capacity), capacity)
