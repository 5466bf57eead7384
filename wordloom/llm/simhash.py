"""SimHash near-duplicates over a Gray-order hierarchical index.

Distinct fingerprints only take part in the search, so a group of exact copies costs one entry however large it is.

* Upper nodes of the index are shared masked bit patterns. At the first level they fix one of four 16-bit blocks: two
  fingerprints that differ in at most three bits agree on one block at least, so a search inside the nodes of all four
  blocks loses no link. A node with too many members is split by the same argument over its free bits, level by level;
  after four levels at most 21 bits are free, which bounds any node.
* Inside a node the members are sorted by Gray rank, groups of eight neighbours are factored into shared patterns,
  groups of groups likewise, and a query walks down adding up its differences from each pattern; a group goes as soon as
  the sum passes the limit, or if it already belongs to the query's own component.

Each node returns a spanning forest, never all of its pairs; components are then joined across nodes by alternating
large-star and small-star rounds on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import checkpointed, slices

MAX_DIFFERENCES = 3
NODE_MEMBERS = 1 << 16
FAN_OUT = 8
LEVELS = 4
SALTS = 16
#: A fingerprint of more than one in HOT of all rows is looked up by broadcast: fewer than HOT rows of 16 bytes.
HOT = 1 << 16
_CHUNK = 1 << 16
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included. Null, empty and wordless texts: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < 3:
        return digest(b" ".join(words), 42)
    ones, total = np.zeros(64, np.int64), n - 2
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + 2]
        hashes = np.array([digest(b"%b %b %b" % x, 42) for x in zip(part, part[1:], part[2:], strict=False)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, fp, extra columns) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[2:]]
    return narrow.mapInArrow(run, ", ".join(["doc_id long", "fp long", *more]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence: the prefix XOR of its bits."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _bits(codes: np.ndarray) -> np.ndarray:
    return _POPCOUNT[np.ascontiguousarray(codes).view(np.uint16).reshape(-1, 4)].sum(axis=1, dtype=np.int16)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split_mask(mask: int) -> list[int]:
    """Four masks that each fix a further quarter of the free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // 4 for k in range(5)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class GrayIndex:
    """The hierarchy over codes that are sorted by (node, Gray rank); nodes is the upper node of each code."""

    def __init__(self, codes: np.ndarray, nodes: np.ndarray):
        self.codes = codes
        n = len(codes)
        start = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        self.levels: list[dict[str, np.ndarray]] = []  # from leaves to roots
        ones, zeros = codes, ~codes
        first, last, owner = np.arange(n), np.arange(n), np.cumsum(np.r_[False, nodes[1:] != nodes[:-1]])
        child = None
        while True:
            self.levels.append({"ones": ones, "mask": ones | zeros, "first": first, "last": last, "child": child})
            if len(ones) == len(start):
                break
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
            lead = np.flatnonzero(place % FAN_OUT == 0)
            child = np.c_[lead, np.r_[lead[1:], len(owner)]]
            ones, zeros = np.bitwise_and.reduceat(ones, lead), np.bitwise_and.reduceat(zeros, lead)
            first, last, owner = first[lead], last[child[:, 1] - 1], owner[lead]
        for above, below in zip(self.levels[1:], self.levels, strict=False):  # what a node adds to the pattern above it
            count = np.diff(above["child"], axis=1)[:, 0]
            below["own"] = below["mask"] & ~np.repeat(above["mask"], count)
        self.levels[-1]["own"] = self.levels[-1]["mask"]
        self.root_of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))

    def links(self, queries: np.ndarray, limit: int, label: np.ndarray | None, most: int) -> np.ndarray | None:
        """Pairs (earlier, later) within limit for these query positions; None if the frontier passes most."""
        top = self.levels[-1]
        q, node = queries, self.root_of[queries]
        diff = _bits((self.codes[q] ^ top["ones"][node]) & top["own"][node])
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = (diff <= limit) & (level["last"][node] > q)
            if label is not None and depth:
                lo, hi = self.span(label, depth)
                keep &= ~((lo[node] == hi[node]) & (lo[node] == label[q]))
            q, node, diff = q[keep], node[keep], diff[keep]
            if not depth:
                return np.c_[q, node]
            begin, end = level["child"][node].T
            count = end - begin
            if count.sum() > most and len(queries) > 1:
                return None
            at = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            q, diff, node = np.repeat(q, count), np.repeat(diff, count), at
            below = self.levels[depth - 1]
            diff = diff + _bits((self.codes[q] ^ below["ones"][node]) & below["own"][node])
        raise AssertionError

    def span(self, label: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        first = self.levels[depth]["first"]
        return np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)

    def forest(self, limit: int, most: int = 1 << 21) -> np.ndarray:
        """The component label (a position) of each code, from links inside each upper node."""
        n = len(self.codes)
        label, at, step = np.arange(n), 0, 1 << 14
        while at < n:
            queries = np.arange(at, min(n, at + step))
            pairs = self.links(queries, limit, label, most)
            if pairs is None:
                step = max(1, step // 4)
                continue
            at, step = at + len(queries), min(1 << 14, step * 2)
            label = _merge(label, pairs)
        return label


def _merge(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """label after the pairs are joined: smallest position of each component."""
    a, b = (label[pairs[:, k]] for k in (0, 1))
    while len(keep := np.flatnonzero(a != b)):
        a, b = a[keep], b[keep]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        up = np.arange(len(label))
        np.minimum.at(up, hi, lo)
        while not np.array_equal(up, further := up[up]):
            up = further
        label, a, b = up[label], up[lo], up[hi]
    return label


def _node_links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads rows sorted by (mask, pattern); works on whole nodes, as many at a time as fit."""

        def solve(mask: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            codes = codes.view(np.uint64)
            node_key = codes & mask.view(np.uint64)
            order = np.lexsort((gray_rank(codes), node_key, mask))
            codes, node_key, mask = codes[order], node_key[order], mask[order]
            nodes = np.cumsum(np.r_[False, (node_key[1:] != node_key[:-1]) | (mask[1:] != mask[:-1])])
            label = GrayIndex(codes, nodes).forest(limit)
            moved = np.flatnonzero(label != np.arange(len(label)))
            pair = [codes[moved].view(np.int64), codes[label[moved]].view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])

        held_mask, held_code = np.array([], np.int64), np.array([], np.int64)
        for batch in batches:
            held_mask = np.r_[held_mask, batch.column(0).to_numpy()]
            held_code = np.r_[held_code, batch.column(1).to_numpy()]
            if len(held_code) < 1 << 19:
                continue
            key = held_code & held_mask
            cut = np.flatnonzero((key[1:] != key[:-1]) | (held_mask[1:] != held_mask[:-1]))
            if len(cut):
                at = cut[-1] + 1
                yield solve(held_mask[:at], held_code[:at])
                held_mask, held_code = held_mask[at:], held_code[at:]
        if len(held_code):
            yield solve(held_mask, held_code)

    return run


def near_links(prints: DataFrame, limit: int = MAX_DIFFERENCES, node_members: int = NODE_MEMBERS) -> DataFrame:
    """(a, b): links that join all distinct fp within limit (0 to 3) differing bits into the right components."""
    if not 0 <= limit <= 3:
        raise ValueError("limit must be from 0 to 3: four blocks find no more")
    parts = None
    open_nodes = prints.select("fp").where("fp is not null").distinct().select(F.lit(0).cast("long").alias("mask"), "fp")
    masks = [0]
    for level in range(LEVELS):
        below = {m: _split_mask(m) for m in masks}
        pick = F.coalesce(*[F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)) for x in to])) for m, to in below.items()])
        split = open_nodes.select(F.explode(pick).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("pattern"), "fp")
        masks = [x for to in below.values() for x in to]
        if level == LEVELS - 1:
            parts = split if parts is None else parts.unionByName(split)
            break
        large = split.groupBy("mask", "pattern").count().where(F.col("count") > node_members).drop("count")
        large = checkpointed(large)
        if large.isEmpty():
            parts = split if parts is None else parts.unionByName(split)
            break
        salted = split.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
        hot = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        settled = salted.join(hot, ["mask", "pattern", "salt"], "left_anti").drop("salt")
        parts = settled if parts is None else parts.unionByName(settled)
        open_nodes = checkpointed(salted.join(hot, ["mask", "pattern", "salt"], "left_semi").select("mask", "fp"))
    dealt = parts.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern").select("mask", "fp")
    return dealt.mapInArrow(_node_links(limit), "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star round; rows (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    met = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))).join(least.hint("merge"), ["a", "salt"])
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.where("salt = 0 and m < a").select("a", F.col("m").alias("b"))
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    links: (a long, b long), any order, repeats and self-links allowed; null ends are left out.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = checkpointed(edges), None
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        edges = checkpointed(_star(_star(edges, True), False))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _components_of(prints: DataFrame, limit: int) -> DataFrame:
    """(fp, n, root): rows and component of each distinct fp."""
    roots = components(near_links(prints, limit))
    counted = prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least_id"))
    return counted.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _looked_up(prints: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """prints with the value that known (fp, n, value) has for its fp, where fp may repeat in a third of all rows.

    A fp with more than one in HOT of all rows is hot: there are fewer than HOT of those, so they are broadcast, and no
    other fp brings more rows to a task than that share.
    """
    least = F.lit((prints.count() // HOT) + HOT)
    hot = F.broadcast(known.where(F.col("n") > least).select("fp", F.struct(value).alias("_hot")))
    met = prints.join(hot, "fp", "left")
    cold = met.where("_hot is null").drop("_hot").join(known.where(F.col("n") <= least).select("fp", value).hint("merge"), "fp")
    return met.where("_hot is not null").select(*prints.columns, F.col(f"_hot.{value}").alias(value)).unionByName(cold)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_DIFFERENCES) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows stay; a null id
    stays null and takes no part in the smallest id, unless its component has no other. An empty table gives no rows.
    Further columns of docs are not read.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    rooted = _components_of(prints, limit)
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = checkpointed(rooted.join(ids.hint("merge"), "root").select("fp", "n", "component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return _looked_up(prints, known, "component_id").select("doc_id", hexed.alias("fingerprint"), "component_id")


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_DIFFERENCES) -> DataFrame:
    """docs with one row of each component: the smallest id (null ids last), of rows that repeat it the smallest hash of the
    text, and of rows that repeat both the smallest by the other columns. Columns, order and names are those of docs.

    Equal rows meet in a partial aggregate before the shuffle, so that a large group of copies costs a row per task.
    """
    own, row = F.col(id_col).cast("long"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    content = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    prints = checkpointed(fingerprints(docs, id_col, text_col, (content.alias("h"),)))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h"))
    best = prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(rank).alias("best"))
    roots = components(near_links(prints, limit)).withColumnRenamed("node", "fp")
    first = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best")).select("best.*")
    keyed = docs.select(own.isNull().alias("late"), F.coalesce(own, F.lit(0)).alias("id"), content.alias("h"), row.alias("row"))
    return keyed.groupBy("late", "id", "h").agg(F.min("row").alias("row")).join(first.hint("merge"), ["late", "id", "h"], "left_semi").select("row.*")
