"""Exact top-k inner products by a dual-tree search over cover trees.

The upper level of the index is one net of centres for the whole table: rows go to the cell of their nearest centre, and a cell
is a ball whose centre, radius and size are known everywhere. A query first searches the cell that can hold the highest score;
with the k-th score found there (or among the centres' sample) it goes on only to those cells whose ball can beat it,

    <centre, query> + radius * |query|  >=  the k-th score so far.

Inside a cell, blocks of rows and groups of queries are indexed by cover trees and searched together: a pair of nodes goes if even

    <centre, centre> + radius * |centre| on either side + radius * radius

stays below the worst k-th score of the query group. Scores are exact integers: products that fit a double's 53 bits are summed
as such; for larger components doubles with an error bound pick the few candidates, and Python's integers decide among those.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import checkpointed, scratch, slices

BLOCK_ROWS = 16384
GROUP_ROWS = 8192
#: Rows that the centres are chosen from, and numbers that these rows may hold: 32 MB, which are broadcast.
SAMPLE_ROWS, SAMPLE_VALUES = 4096, 1 << 22
LEAF = 48
#: Components become multiples of 1 / SCALE. Rows of one BAND (by the exponent of their largest component) are indexed
#: together, scaled by a power of two, so that no square leaves the range of doubles; bounds between bands are in units of
#: 2^UNIT, for a query whose largest component is scaled to [1, 2).
SCALE, BAND, UNIT = 1024, 256, 64
_EXACT = float(1 << 53)
_SLACK = 1e-9  # of the product of norms: above any error of a sum of products
_NONE = np.array([], np.int64)


class CoverTree:
    """Batch-built cover tree over rows of points.

    A node covers its points within `reach`, half its parent's; its children's centres are points of its own, more than
    their reach apart, the first one the node's own centre (nesting, covering, separation). Nodes of at most LEAF points
    are leaves. radius is the exact largest distance to a point below.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.norm = np.sqrt((points**2).sum(axis=1))
        self._square = self.norm**2
        centre, radius, self.children, self.rows = [], [], [], []

        def node(at: int, rows: np.ndarray) -> int:
            centre.append(at)
            radius.append(float(np.sqrt(((points[rows] - points[at]) ** 2).sum(axis=1)).max()) if len(rows) > 1 else 0.0)
            self.rows.append(rows)
            self.children.append(_NONE)
            return len(centre) - 1

        self.root = node(0, np.arange(len(points))) if len(points) else -1
        todo = [self.root] if len(points) else []
        while todo:
            top = todo.pop()
            if len(self.rows[top]) <= leaf or not radius[top]:
                continue
            made = [node(at, rows) for at, rows in self._net(centre[top], self.rows[top], radius[top] / 2)]
            self.children[top] = np.array(made)
            todo += made
        self.centre, self.radius = np.array(centre, np.int64), np.array(radius)

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self._square[a][:, None] + self._square[b][None, :] - 2 * (self.points[a] @ self.points[b].T), 0))

    def _net(self, own: int, rows: np.ndarray, reach: float, block: int = 512) -> list[tuple[int, np.ndarray]]:
        """Centres more than reach apart, own first, and the rows nearest to each within reach."""
        centres, members = [own], [[] for _ in range(1)]
        for at in range(0, len(rows), block):
            part = rows[at : at + block]
            far = self._far(part, np.array(centres))
            near, least = far.argmin(axis=1), far.min(axis=1)
            near[part == own], least[part == own] = 0, 0.0
            for k in np.unique(near[least <= reach]):
                members[k].append(part[(near == k) & (least <= reach)])
            left = part[least > reach]
            apart, open_ = self._far(left, left), np.ones(len(left), bool)
            for i in range(len(left)):
                if open_[i]:
                    mine = open_ & (apart[i] <= reach)
                    mine[i] = True
                    open_ &= ~mine
                    centres.append(int(left[i]))
                    members.append([left[mine]])
        return [(c, np.concatenate(m)) for c, m in zip(centres, members, strict=True) if m]


class Best:
    """The k best (score, smaller id first) of each query of a group; least is a score that the k best are known to reach."""

    def __init__(self, n: int, k: int, ids: np.ndarray, least: np.ndarray | None = None):
        self.k, self.names = k, ids
        self.least = np.full(n, -np.inf) if least is None else least
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.score[rows, -1], self.least[rows]).min())

    def add(self, rows: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        """score: (rows, candidates); at: the candidates' places, in ascending order, as their ids are."""
        ids = self.names[at]
        if score.shape[1] > self.k:
            floor = np.maximum(np.partition(score, -self.k, axis=1)[:, -self.k], self.score[rows, -1])
            useful = (score >= floor[:, None]).any(axis=0)
            score, ids = score[:, useful], ids[useful]
        both = np.concatenate([self.score[rows], score], axis=1)
        names = np.concatenate([self.ids[rows], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(both, order, axis=1)
        self.ids[rows] = np.take_along_axis(names, order, axis=1)


class Likely(Best):
    """For scores that doubles only approach: score holds the k best lower bounds, and near every candidate whose upper bound
    reached the k-th of them when it was met."""

    def __init__(self, n: int, k: int, ids: np.ndarray, least: np.ndarray | None, left: np.ndarray, right: np.ndarray, dim: int):
        super().__init__(n, k, ids, least)
        self.left, self.right, self.part = left, right, (dim + 8) * 2.0**-52
        self.near: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]

    def add(self, rows: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        error = self.part * self.left[rows][:, None] * self.right[at][None, :]
        super().add(rows, score - error, at)
        high = score + error
        for i, row in enumerate(rows):
            keep = np.flatnonzero((high[i] >= max(self.score[row, -1], self.least[row])) & np.isfinite(score[i]))
            if len(keep):
                self.near[row].append((at[keep], high[i, keep]))

    def candidates(self, row: int) -> np.ndarray:
        if not self.near[row]:
            return _NONE
        at, high = (np.concatenate(x) for x in zip(*self.near[row], strict=True))
        return at[high >= max(self.score[row, -1], self.least[row])]


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, best: Best, chunk: int = 64) -> Best:
    """Dual-tree search, query nodes depth first and data nodes by their bounds. data_ids are in ascending order."""
    if queries.root < 0 or data.root < 0:
        return best

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        """The highest score that any pair of points below q and each node can have, over any error of the sums."""
        centres, radius, own = data.centre[nodes], data.radius[nodes], queries.radius[q]
        dots = data.points[centres] @ queries.points[queries.centre[q]]
        norm = queries.norm[queries.centre[q]] + own
        return dots + own * data.norm[centres] + radius * norm + _SLACK * norm * (data.norm[centres] + radius)

    todo = [(queries.root, np.array([data.root]))]
    while todo:
        q, nodes = todo.pop()
        rows, most = queries.rows[q], bounds(q, nodes)
        if len(queries.children[q]):
            while len(nodes) < 4 * len(queries.children[q]) and any(len(data.children[x]) for x in nodes):  # both sides go down
                nodes = np.concatenate([data.children[x] if len(data.children[x]) else [x] for x in nodes])
                most = bounds(q, nodes)
            nodes = nodes[most >= best.worst(rows)]
            todo += [(child, nodes) for child in queries.children[q]]
            continue
        while len(nodes):
            keep = most >= best.worst(rows)
            nodes, most = nodes[keep], most[keep]
            first = np.argpartition(-most, chunk)[:chunk] if len(nodes) > chunk else np.arange(len(nodes))
            now = nodes[first]
            nodes, most = np.delete(nodes, first), np.delete(most, first)
            leaves = [x for x in now if not len(data.children[x])]
            if leaves:
                at = np.sort(np.concatenate([data.rows[x] for x in leaves]))
                score = queries.points[rows] @ data.points[at].T
                score[query_ids[rows][:, None] == data_ids[at][None, :]] = -np.inf
                best.add(rows, score, at)
            under = [data.children[x] for x in now if len(data.children[x])]
            if under:
                under = np.concatenate(under)
                nodes, most = np.r_[nodes, under], np.r_[most, bounds(q, under)]
    return best


def _matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Components cut down to multiples of 1 / SCALE; large doubles are such multiples already."""
    x = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)
    small = np.abs(x) < 2.0**42
    return np.where(small, np.floor(np.where(small, x, 0) * SCALE) / SCALE, x)


def _lead(x: np.ndarray) -> np.ndarray:
    """Exponent of each row's largest component."""
    return np.frexp(np.abs(x).max(axis=1, initial=0.0))[1] - 1


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _size(x: np.ndarray) -> np.ndarray:
    """Norms of rows of any magnitude, in units of 2^UNIT."""
    lead = _lead(x)
    return np.ldexp(_norms(np.ldexp(x, -lead[:, None])), lead - UNIT)


def _whole(x: float) -> int:
    n, d = float(x).as_integer_ratio()
    return n * SCALE // d


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    return sum(_whole(x) * _whole(y) for x, y in zip(a, b, strict=True))


def _key(score: int) -> bytes:
    """Orders scores outside the range of a long, as bytes; empty for any other."""
    if -(1 << 63) < score < (1 << 63) - 1:
        return b""
    n = (abs(score).bit_length() + 7) // 8
    return (0x8000 + n).to_bytes(2, "big") + score.to_bytes(n, "big") if score > 0 else (0x8000 - n).to_bytes(2, "big") + ((1 << 8 * n) - 1 + score).to_bytes(n, "big")


def _in_units(score: int, lead: int) -> float:
    """A score as a double just below it, for the query's largest component scaled to [1, 2), in units of 2^UNIT."""
    cut = max(0, abs(score).bit_length() - 60)
    about = math.ldexp(score >> cut, cut - 20 - UNIT - lead)
    return about - abs(about) * 1e-15


def _unit_search(k: int, fields: tuple[str, ...]):
    """Cogroup function: a group of queries (q, vec_id, v, least) against a block of rows (vec_id, v) of one cell."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            dim, band = key[0].as_py(), key[1].as_py()
            q, d = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
            qid, did = (t.column("vec_id").to_numpy() for t in (left, right))
            order, lead, least = np.argsort(did, kind="stable"), _lead(q), left.column("least").to_numpy()
            d, did, no = d[order], did[order], left.column("q").to_numpy()
            if np.ldexp(1.0, lead.max() + 1) * np.abs(d).max(initial=0) * dim * SCALE**2 < _EXACT:
                whole_q, whole_d = q * SCALE, d * SCALE
                best = search(CoverTree(whole_q), qid, CoverTree(whole_d), did, Best(len(q), k, did, np.ldexp(least, 20 + UNIT + lead)))
                rows, cols = np.nonzero(np.isfinite(best.score))
                found = [(no[r], qid[r], best.ids[r, c], s := int(best.score[r, c]), b"", _in_units(s, int(lead[r]))) for r, c in zip(rows, cols, strict=True)]
            else:
                scaled_d, scaled_q = np.ldexp(d, -BAND * band), np.ldexp(q, -lead[:, None])
                same = np.unique(scaled_d, axis=0, return_inverse=True)[1].ravel()  # copies: only the k + 1 smallest ids can matter
                by = np.lexsort((np.arange(len(d)), same))
                start = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
                nth = np.arange(len(d)) - np.repeat(start, np.diff(np.r_[start, len(d)]))
                keep = np.sort(by[nth <= k])
                d, did, scaled_d = d[keep], did[keep], scaled_d[keep]
                least = np.ldexp(least, UNIT - BAND * band)
                best = search(CoverTree(scaled_q), qid, CoverTree(scaled_d), did, Likely(len(q), k, did, least, _norms(scaled_q), _norms(scaled_d), dim))
                for r in range(len(q)):
                    scored = sorted((-_exact(q[r], d[j]), int(did[j])) for j in best.candidates(r))[:k]
                    found += [(no[r], qid[r], j, max(-(1 << 63), min((1 << 63) - 1, -s)), _key(-s), _in_units(-s, int(lead[r]))) for s, j in scored]
        cols = zip(*found, strict=True) if found else ((),) * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64())
        return pa.table({f: pa.array(c, t) for f, c, t in zip(fields, cols, types, strict=True)})

    return run


@dataclass
class Cells:
    """The upper level: centres by (dim, band), with their cells' numbers, and each cell's radius in units of 2^UNIT. A cell
    without a centre (number -1) is a ball around zero. sample holds what the centres were chosen from."""

    centres: dict[tuple[int, int], np.ndarray]
    sample: dict[int, tuple[np.ndarray, np.ndarray]]  # by dim: ids, rows
    radius: dict[tuple[int, int, int], float]

    def assign(self, x: np.ndarray, dim: int, band: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centre in units of 2^UNIT) of rows of one band."""
        local, centres = np.ldexp(x, -BAND * band), self.centres.get((dim, band))
        if centres is None:
            return np.full(len(x), -1), np.ldexp(_norms(local) * (1 + 1e-12), BAND * band - UNIT)
        c = np.ldexp(centres, -BAND * band)
        cell = np.concatenate([((c * c).sum(axis=1)[None, :] - 2 * (local[i : i + 4096] @ c.T)).argmin(axis=1) for i in range(0, len(x), 4096)])
        return cell, np.ldexp(_norms(local - c[cell]) * (1 + 1e-12), BAND * band - UNIT)

    def bounds(self, q: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The (band, cell)s of the queries' length, and the highest score that each query can have there."""
        dim, scaled = q.shape[1], np.ldexp(q, -_lead(q)[:, None])
        norm, keys, most = _norms(scaled), [], []
        for (of, band, cell), radius in self.radius.items():
            if of != dim:
                continue
            c = self.centres[dim, band][cell] if cell >= 0 else np.zeros(dim)
            keys.append((band, cell))
            most.append(scaled @ np.ldexp(c, -UNIT) + norm * radius + _SLACK * norm * (_size(c[None, :])[0] + radius))
        return keys, np.array(most).reshape(len(keys), len(q)).T

    def least(self, q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """A score that the k best of each query reach, from the sample."""
        names, rows = self.sample.get(q.shape[1], (_NONE, np.zeros((0, q.shape[1]))))
        if len(names) <= k:
            return np.full(len(q), -np.inf)
        scaled = np.ldexp(q, -_lead(q)[:, None])
        low = scaled @ np.ldexp(rows, -UNIT).T - _SLACK * _norms(scaled)[:, None] * _size(rows)[None, :]
        low[ids[:, None] == names[None, :]] = -np.inf
        return np.partition(low, -k, axis=1)[:, -k]


def _chosen(rows: np.ndarray, n: int) -> np.ndarray:
    """n rows at most that are far from each other, each the farthest from those before it."""
    at, far = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(at) < min(n, len(rows)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[at[-1]]) ** 2).sum(axis=1))
    return np.array(at)


def fit_cells(rows: DataFrame, n: int, widest: int, block_rows: int = BLOCK_ROWS) -> Cells:
    """Centres for rows (vec_id, v, dim, band): one per block_rows rows, chosen from a sample by hash of at most SAMPLE_ROWS rows
    and SAMPLE_VALUES components. Radii are still unknown."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, widest)))
    h = F.xxhash64("vec_id", "v")
    share = min(1.0, 2.0 * most / max(1, n))
    likely = rows.where(F.pmod(h, F.lit(1 << 40)) < F.lit(share) * (1 << 40)).distinct().withColumn("h", h)
    got = likely.orderBy("h", "vec_id").limit(most).toArrow()
    dims, bands, ids = (got.column(c).to_numpy() for c in ("dim", "band", "vec_id"))
    cells = Cells({}, {}, {})
    for dim in np.unique(dims):
        of = np.flatnonzero(dims == dim)
        x = _matrix(got.column("v").take(of), int(dim))
        cells.sample[int(dim)] = ids[of], x
        for band in np.unique(bands[of]):
            mine = x[bands[of] == band]
            share = len(mine) / len(dims)
            cells.centres[int(dim), int(band)] = mine[_chosen(np.ldexp(mine, -BAND * int(band)), max(1, math.ceil(share * n / block_rows)))]
    return cells


def _by_dim(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column(batch.schema.names.index("dim")).to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


_DATA = "vec_id long, v array<double>, dim int, band int, cell int, far double"
_ASKED = "q long, vec_id long, v array<double>, dim int, band int, cell int, least double"
_FOUND = ("q", "query_id", "vec_id", "score", "tie", "low")


def _routes(asked: DataFrame, cells: Cells, k: int, home: bool) -> DataFrame:
    """Rows (q, vec_id, v, dim, least) by the cells that they have to search: the one with the highest bound, or all others
    whose bound reaches least. least becomes the better one of itself and the sample's."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            table = pa.Table.from_batches([batch])
            for dim, at in _by_dim(batch):
                part = table.take(at)
                x = _matrix(part.column("v"), dim)
                keys, most = shared.value.bounds(x)
                least = np.maximum(part.column("least").to_numpy(), shared.value.least(x, part.column("vec_id").to_numpy(), k))
                first = most.argmax(axis=1)
                go = np.zeros(most.shape, bool) if home else most >= least[:, None]
                go[np.arange(len(x)), first] = home
                rows, cols = np.nonzero(go)
                own = part.take(rows)
                band, cell = (pa.array([keys[c][i] for c in cols], pa.int32()) for i in (0, 1))
                made = pa.table({"q": own.column("q"), "vec_id": own.column("vec_id"), "v": own.column("v"), "dim": own.column("dim"), "band": band, "cell": cell, "least": pa.array(least[rows])})
                yield from made.combine_chunks().to_batches(max_chunksize=4096)

    return asked.select("q", "vec_id", "v", "dim", "least").mapInArrow(run, _ASKED)


def _searched(routed: DataFrame, data: DataFrame, sizes: DataFrame, k: int, block_rows: int, group_rows: int) -> DataFrame:
    """What each unit of work finds: a group of the queries routed to a cell against a block of the cell's rows. Only cells that
    are asked have units; tables of one row per cell say into how many groups and blocks each is cut."""
    keys = ["dim", "band", "cell"]
    routed = checkpointed(routed)
    parts = routed.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(group_rows)).cast("int").alias("parts"))
    cut = F.broadcast(checkpointed(sizes.join(parts, keys).select(*keys, "parts", F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("blocks"))))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = routed.join(cut, keys).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).withColumn("block", numbers("blocks"))
    right = data.join(cut, keys).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("part", numbers("parts"))
    unit = [*keys, "block", "part"]
    pairs = left.select(*unit, "q", "vec_id", "v", "least").groupBy(*unit).cogroup(right.select(*unit, "vec_id", "v").groupBy(*unit))
    return pairs.applyInArrow(_unit_search(k, _FOUND), "q long, query_id long, vec_id long, score long, tie binary, low double")


def exact_top_k(vectors: DataFrame, k: int = 10, query_divisor: int = 100, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest score per query, ties to the smaller vec_id.

    Components become floor(1024 * x). Queries are the rows whose id is divisible by query_divisor, candidates all rows
    with another id. Vectors that are null or hold null or non-finite components, and null ids, take no part; vectors of
    different lengths are never compared. Rows that repeat a vec_id are candidates each, a repeated query id is asked
    once per distinct vector and its answers share the ranks. Fewer candidates than k: all of them. Every finite double is
    taken exactly; scores past the range of a long are ordered by their value and shown as its ends. Other columns are not
    read; an empty table gives no rows.
    """
    rows, sizes = _usable(vectors, id_col, vector_col)
    n, widest = sizes
    data, cells, counts = _indexed(rows, n, widest, block_rows)
    spark, path = vectors.sparkSession, scratch(vectors.sparkSession, "asked")
    asked = data.where(F.col("vec_id") % query_divisor == 0).select("vec_id", "v", "dim").distinct()
    asked.select(F.monotonically_increasing_id().alias("q"), "vec_id", "v", "dim", F.lit(float("-inf")).alias("least")).write.parquet(path)
    asked = spark.read.parquet(path)
    first = checkpointed(_searched(_routes(asked, cells, k, True), data, counts, k, block_rows, group_rows))
    kth = first.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("nth") == k).select("q", F.col("low").alias("reached"))
    known = asked.join(kth.hint("merge"), "q", "left").withColumn("least", F.greatest("least", F.coalesce("reached", F.lit(float("-inf")))))
    second = _searched(_routes(known, cells, k, False), data, counts, k, block_rows, group_rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("tie"), "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, tuple[int, int]]:
    """Rows (vec_id, v, dim, band) that take part, their number and largest length."""
    v = F.col(vector_col).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col(id_col).isNotNull()
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    largest = F.aggregate("v", F.lit(1.0), lambda m, x: F.greatest(m, F.abs(x)))
    rows = rows.select("vec_id", "v", F.size("v").alias("dim"), F.floor(F.log2(largest) / BAND).cast("int").alias("band"))
    got = rows.agg(F.count("*"), F.max("dim")).first()
    return rows, (got[0], got[1] or 0)


def _indexed(rows: DataFrame, n: int, widest: int, block_rows: int) -> tuple[DataFrame, Cells, DataFrame]:
    """The rows with uid and cell, written once; the cells; and a row (dim, band, cell, n) per cell, of which there are at
    most as many as sample rows, bands and lengths of vectors."""
    cells = fit_cells(rows, n, widest, block_rows)
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "vectors")
    shared = spark.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            table = pa.Table.from_batches([batch])
            for dim, of in _by_dim(batch):
                bands = table.column("band").to_numpy()[of]
                for band in np.unique(bands):
                    part = table.take(of[bands == band])
                    cell, far = shared.value.assign(_matrix(part.column("v"), dim), dim, int(band))
                    made = part.append_column("cell", pa.array(cell, pa.int32())).append_column("far", pa.array(far))
                    yield from made.combine_chunks().to_batches()

    rows.mapInArrow(run, _DATA).withColumn("uid", F.monotonically_increasing_id()).write.parquet(path)
    data = spark.read.parquet(path)
    counts = checkpointed(data.groupBy("dim", "band", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")))
    cells.radius = {(r.dim, r.band, r.cell): r.far for r in counts.collect()}
    return data, cells, counts.select("dim", "band", "cell", "n")


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
           where embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
      from v q join v d on q.vec_id % 100 = 0 and d.vec_id <> q.vec_id and len(q.v) = len(d.v)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
