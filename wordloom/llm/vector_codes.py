"""Vector code compression: product codes of whole-number vectors, with exact k-means found by Exponion search.

A vector becomes whole numbers, floor(SCALE * x), cut into consecutive parts; each part position has a codebook, and a
vector's code names the nearest entry of each. The codebooks start as the parts of the first rows by id and are refined in
rounds: every part goes to its nearest entry, then each entry becomes the floor of the mean of its parts.

The search of a part x starts at its entry a of the round before. An entry c can be as near as a only if

    |a - c| <= |a - x| + |x - c| <= 2 |a - x|,    so    |a - c|^2 <= 4 |a - x|^2,

which whole numbers decide exactly. Each entry has the list of all entries by distance; only its beginning up to that radius
is scanned, in rings that double. Of equally near entries the first one wins, and it is always inside the radius.

A round is one pass over the rows: it writes them with their new codes, and beside them each task's counts and sums per
entry, from which the driver makes the next codebooks (entries times components numbers, whatever the number of rows). The
next round reads what was written and the table before goes.
"""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import dropped, scratch, slices

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Labels with over this share of all rows get their sums by broadcast: fewer than so many labels.
HOT = 1024
_EXACT = 1 << 53
_ROWS = 16384


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, as doubles if all are small, else as Python's integers (scale: a power of two)."""
    scaled = np.floor(np.ldexp(np.clip(x, -1e300, 1e300), int(math.log2(scale))))
    if not x.size or np.abs(scaled).max() < 1 << 24:
        return scaled
    many = [int(b) if abs(a) < 1e300 else int(a) * scale for a, b in zip(x.ravel().tolist(), scaled.ravel().tolist(), strict=True)]
    return np.array([*many, None], object)[:-1].reshape(x.shape)


def edges(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end; equal parts if their number divides the width."""
    return [width * p // parts for p in range(parts + 1)]


class Codebook:
    """The entries of one part position, each with all entries in order of their distance from it."""

    def __init__(self, entries: list[list[int]]):
        self.n, self.width = len(entries), len(entries[0])
        self.most = max((abs(x) for row in entries for x in row), default=0)
        self.exact = np.array([*(x for row in entries for x in row), None], object)[:-1].reshape(self.n, self.width)
        self._by_kind: dict[str, tuple] = {}

    def _small(self, most: int) -> bool:
        """Whether squared distances of components up to most, times n, are exact in doubles."""
        return (2 * most + 2) ** 2 * max(1, self.width) * self.n < _EXACT

    def _index(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries, squared lengths, and for each entry the places of all by distance, with the distances."""
        if kind not in self._by_kind:
            self._by_kind[kind] = self._sorted(self.exact.astype(kind))
        return self._by_kind[kind]

    @staticmethod
    def _sorted(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        square = (c * c).sum(axis=1)
        apart = square[:, None] - 2 * (c @ c.T) + square[None, :]
        order = np.argsort(apart, axis=1, kind="stable")
        return c, square, order, np.take_along_axis(apart, order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of whole numbers x, searched from the entries start."""
        if x.dtype != object and not self._small(max(self.most, int(np.abs(x).max(initial=0)))):
            x = np.array([*map(int, x.ravel().tolist()), None], object)[:-1].reshape(x.shape)
        if x.dtype == object:
            start = start.astype(object)
        c, square, order, apart = self._index("O" if x.dtype == object else "f8")
        first = start.astype(np.int64)
        off = x - c[first]
        reached = (off * off).sum(axis=1)  # squared distance from the entry before
        best = reached * self.n + start  # an entry's place below its distance: the least of these decides ties
        if self.width:
            own = (x * x).sum(axis=1)
            rows_by_entry = np.argsort(first, kind="stable")
            for rows in np.split(rows_by_entry, np.flatnonzero(np.diff(first[rows_by_entry])) + 1) if len(x) else []:
                a = first[rows[0]]
                within = np.searchsorted(apart[a], 4 * reached[rows], side="right")
                rows, within = rows[(turn := np.argsort(-within, kind="stable"))], within[turn]
                at, ring = 0, 8
                while at < within[0]:
                    live = rows[: np.searchsorted(-within, -at, side="left")]  # rows whose radius goes beyond
                    near = order[a][at : min(at + ring, within[0])]
                    far = own[live][:, None] - 2 * (x[live] @ c[near].T) + square[near][None, :]
                    best[live] = np.minimum(best[live], (far * self.n + near).min(axis=1))
                    at, ring = at + len(near), 2 * ring
        elif self.n:
            best = best * 0  # parts without components: all entries are equal
        return (best % self.n).astype(np.int64), best // self.n


@dataclass
class Codebooks:
    """entries: per part position, per entry, whole components. scale: what vectors were multiplied by."""

    entries: list[list[list[int]]]
    scale: int = SCALE

    @property
    def width(self) -> int:
        return sum(len(part[0]) for part in self.entries)

    def sha256(self) -> str:
        numbers = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decoded(self, codes: list[int]) -> list[float]:
        """The vector that a code stands for."""
        return [x / self.scale for part, at in zip(self.entries, codes, strict=True) for x in part[at]]


def usable(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def first_codebooks(ready: DataFrame, order: Column, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the first rows in the order, null ids last and equal ids by their vectors; None without rows. The first
    row's length is that of all vectors with a code."""
    rows = ready.orderBy(order.asc_nulls_last(), "vector").limit(entries).collect()
    if not rows:
        return None
    width = len(rows[0]["vector"])
    cut = edges(width, parts)
    vectors = [[int(x) for x in whole(np.array(r["vector"], "f8"), scale).tolist()] for r in rows if len(r["vector"]) == width]
    return Codebooks([[v[a:b] for v in vectors] for a, b in zip(cut, cut[1:])], scale)


def _coded(batches: Iterator[pa.RecordBatch], books: Codebooks, indexed: list[Codebook], put) -> Iterator[pa.RecordBatch]:
    """Each batch with codes and distances by put(batch, codes, distances); sums for the next codebooks, if put is asked to
    keep them, come from its caller. codes has -1 for vectors of another length."""
    cut = edges(books.width, len(indexed))
    for batch in slices(batches, _ROWS):
        vectors = batch.column(1)
        fits = np.diff(vectors.offsets.to_numpy()) == books.width
        some = vectors.filter(pa.array(fits)) if not fits.all() else vectors
        x = whole(some.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(int(fits.sum()), books.width), books.scale)
        before = batch.column(2).filter(pa.array(fits))
        start = np.frombuffer(b"".join(before.to_pylist()), "<u2").reshape(len(x), -1).astype(np.int64) if not before.null_count else np.zeros((len(x), len(indexed)), np.int64)
        found = [book.nearest(x[:, a:b], start[:, p]) for p, (book, a, b) in enumerate(zip(indexed, cut, cut[1:]))]
        codes = np.stack([f[0] for f in found], axis=1) if found else np.zeros((len(x), 0), np.int64)
        yield from put(batch, fits, x, codes, [f[1] for f in found])


def _one_round(ready: DataFrame, books: Codebooks, path: str) -> Codebooks:
    """Writes the rows with their entries to path, and returns the entries moved to the means of their parts."""
    shared, n = ready.sparkSession.sparkContext.broadcast(books), len(books.entries[0])
    row, vector = ready.schema["row"].dataType.simpleString(), ready.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, indexed = shared.value, [Codebook(e) for e in shared.value.entries]
        cut = edges(own.width, len(indexed))
        count = np.zeros((len(indexed), n), np.int64)
        total = np.zeros((n, own.width), object)

        def put(batch, fits, x, codes, _):
            for p, (a, b) in enumerate(zip(cut, cut[1:])):
                count[p] += np.bincount(codes[:, p], minlength=n)
                if x.dtype == object:
                    np.add.at(total[:, a:b], codes[:, p], x[:, a:b])
                else:  # exact: few rows of small numbers
                    total[:, a:b] += np.stack([np.bincount(codes[:, p], x[:, j], n) for j in range(a, b)], axis=1).astype(np.int64).astype(object) if b > a else 0
            data = iter(codes.astype("<u2").reshape(len(codes), -1))
            marks = pa.array([next(data).tobytes() if ok else None for ok in fits.tolist()], pa.binary())
            nothing = [pa.nulls(len(fits), kind) for kind in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks, *nothing], names)

        names, kinds = ["row", "vector", "code", "part", "entry", "n", "total"], None
        for out in _coded(batches, own, indexed, put):
            kinds = out.schema
            yield out
        if kinds is not None:
            used = [(p, e) for p in range(len(indexed)) for e in np.flatnonzero(count[p]).tolist()]
            sums = [[str(s) for s in total[e, cut[p] : cut[p + 1]]] for p, e in used]
            cols = [pa.nulls(len(used), kinds.field(k).type) for k in range(3)]
            cols += [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(count[p, e]) for p, e in used], pa.int64()), pa.array(sums, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names)

    ready.mapInArrow(run, f"row {row}, vector {vector}, code binary, part int, entry int, n long, total array<string>").write.parquet(path)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}  # an entry is in one partition only
        for batch in batches:
            for at, e, count, sums in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = found.get((at, e), [0, [0] * len(sums)])
                found[at, e] = [own[0] + count, [a + int(b) for a, b in zip(own[1], sums, strict=True)]]
        rows = [{"part": at, "entry": e, "n": count, "total": [str(x) for x in sums]} for (at, e), (count, sums) in found.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema({"part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "total": pa.list_(pa.string())}))

    sums = ready.sparkSession.read.parquet(path).where("part is not null").select("part", "entry", "n", "total")
    moved = [[list(e) for e in part] for part in books.entries]
    for r in sums.repartition("part", "entry").mapInArrow(added, "part int, entry int, n long, total array<string>").collect():  # a row per entry
        moved[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["total"]]
    return Codebooks(moved, books.scale)


def compressed(rows: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(row, codes, error) of each row with a usable vector, and the codebooks after the last round: row is the struct of all
    columns, codes an array<int> with the nearest entry of each part, error its squared distance in whole numbers.

    scale is a power of two. Vectors that are null or hold null or non-finite components are left out. Null ids come last in
    the order of the first entries, equal ids by their vectors; repeated rows count as often as they occur. With fewer rows
    than entries there are as many entries as rows; an empty table gives no rows and no codebooks (None). A vector whose length
    isn't that of the first row has no part in the codebooks, and null codes and error. Lengths that the parts do not divide are
    cut as evenly as can be. Every finite double is taken exactly; an error beyond 64 bits is null. Columns may have any
    names, also those of the result.
    """
    if entries > 1 << 16 or scale & (scale - 1):
        raise ValueError("at most 65,536 entries, and a power of two as scale")
    spark = rows.sparkSession
    kind = rows.schema[vector].dataType.simpleString()
    column = F.col(f"`{vector}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector}`").cast("array<double>")
    ready = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), column.alias("vector"), F.lit(None).cast("binary").alias("code")).where(usable(F.col("vector")))
    books = first_codebooks(ready, F.col("row").getField(order), parts, entries, scale)
    row = ready.schema["row"].dataType.simpleString()
    if books is None:
        return spark.createDataFrame([], f"row {row}, codes array<int>, error long"), None
    before = None
    for k in range(rounds):
        path = scratch(spark, f"codes{k}")
        books = _one_round(ready, books, path)
        if before:
            dropped(spark, before)
        ready, before = spark.read.parquet(path).where("part is null").select("row", "vector", "code"), path
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(batch, fits, _, codes, distances):
            errors = [sum(map(int, d)) for d in zip(*distances)] if distances else [0] * len(codes)
            each = iter(zip(codes.tolist(), errors, strict=True))
            made = [next(each) if ok else (None, None) for ok in fits.tolist()]
            error = [e if e is not None and e < 1 << 63 else None for _, e in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in made], pa.list_(pa.int32())), pa.array(error, pa.int64())], ["row", "codes", "error"])

        return _coded(batches, shared.value, [Codebook(e) for e in shared.value.entries], put)

    return ready.mapInArrow(run, f"row {row}, codes array<int>, error long"), books


def group_sums(rows: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """rows with out: the sum of value over all rows with an equal label, nulls together; null if a value is null or the sum
    leaves 64 bits. Sums are made before the shuffle; labels of more than a HOT-th of all rows, fewer than HOT, take
    theirs by broadcast, so that no task holds the rows of one of them. Reads rows three times."""
    sums = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"), F.when(F.count("*") == F.count(value), F.try_sum(value)).alias(out))
    many = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot, cold = sums.where(F.col("_n") * HOT > many).withColumn("_hot", F.lit(True)), sums.where(F.col("_n") * HOT <= many)
    met = rows.join(F.broadcast(hot), F.col(label).eqNullSafe(F.col("_label")), "left")
    done = met.where("_hot").select(*rows.columns, out)
    rest = met.where("_hot is null").select(*rows.columns)
    return done.unionByName(rest.join(cold, F.col(label).eqNullSafe(F.col("_label"))).select(*rows.columns, out))


def vector_codes(rows: DataFrame) -> DataFrame:
    """Per usable vector of embeddings: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256. What odd
    rows give is stated in compressed() and group_sums(); a null code stands for a vector of another length."""
    spark = rows.sparkSession
    made, books = compressed(rows.select("vec_id", "embedding", "label"))
    path = scratch(spark, "coded")
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    made.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), digits.alias("code"), "error").write.parquet(path)
    summed = group_sums(spark.read.parquet(path), "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds over lists of doubles, which hold these whole numbers exactly."""
    far = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(({far}) * {ENTRIES} + e) AS key FROM parts JOIN b{k} USING (p) GROUP BY r, p)")
        if k < ROUNDS:
            steps.append(
                f"m{k} AS (SELECT p, e, list(mean ORDER BY j) AS c FROM (SELECT p, CAST(key AS BIGINT) % {ENTRIES} AS e, j, floor(sum(x[j]) / count(*)) AS mean "
                f"FROM a{k}, range(1, len(x) + 1) AS t(j) GROUP BY ALL) GROUP BY p, e), "
                f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN m{k} AS m USING (p, e))"
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES}),
{", ".join(steps)},
whole AS (SELECT r, string_agg(printf('%02x', CAST(key AS BIGINT) % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(CAST(key AS BIGINT) // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(c[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}, range(1, len(c) + 1) AS t(j)) AS codebooks_sha256
FROM kept JOIN whole USING (r)
"""


ORACLE_SQL = _sql()
