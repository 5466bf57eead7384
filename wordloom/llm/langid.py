"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of hashed n-grams (one to three letters of the lower-cased text, and whole
words). Spherical k-means clusters a bounded sample of each language; a text takes the language of the centroid with the
highest cosine, and is rejected if even that one is further away than texts of its language ever are that have about as
many distinct n-grams: short texts are far from any centroid. Document frequencies cover all training rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import slices

BINS = 4096
CENTROIDS = 4
#: Bound of the sample that k-means reads, per language.
SAMPLE_PER_LANGUAGE = 512
#: A text is rejected if its best cosine is below this share of the lowest one among its language's sample texts, and
#: their beginnings of EXCERPTS characters, with as many distinct n-grams by powers of two.
REJECT_SHARE = 0.35
EXCERPTS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
_CLASSES = BINS.bit_length()
UNKNOWN = "und"
_PIECE = 1 << 20
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts over BINS bins; None if text is null or has no letter. Whole texts, in pieces of bounded size."""
    if not text:
        return None
    out = np.zeros(BINS)
    some = False
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        if not letter.any():
            continue
        some = True
        keep = letter | np.r_[True, letter[:-1]]  # one blank stands for each run of other characters
        c = np.r_[np.uint64(32), np.where(letter, codes, 32)[keep].astype(np.uint64), np.uint64(32)]
        one, two, three = c, c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77), None
        three = two[:-1] * np.uint64(0xC2B2AE3D) + c[2:] * np.uint64(0x27D4EB2F)
        stops = np.flatnonzero(c == 32)
        sums = np.cumsum((c * np.uint64(0x9E3779B97F4A7C15)) ^ (c << np.uint64(17)), dtype=np.uint64)
        words = (sums[stops[1:]] - sums[stops[:-1]])[np.diff(stops) > 1] * np.uint64(0xD6E8FEB86659FD93)
        for grams in (one[one != 32], two, three, words):
            mixed = (grams ^ (grams >> np.uint64(15))) * np.uint64(0x2C1B3C6D297A2D39)
            out += np.bincount((mixed >> np.uint64(40)).astype(np.int64) & (BINS - 1), minlength=BINS)
    return out if some else None


def _size_class(count: np.ndarray) -> int:
    return int(np.count_nonzero(count)).bit_length() - 1


def _floors(heads: list[str], whole: list[np.ndarray], idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lowest accepted cosine per size class; a class that no text or excerpt falls into takes that of the next smaller."""
    lowest = np.full(_CLASSES, np.inf)
    cuts = (counts(head[:cut]) for head in heads for cut in EXCERPTS if cut <= len(head))
    for count in (*(c for c in cuts if c is not None), *whole):
        size = _size_class(count)
        lowest[size] = min(lowest[size], float((centres @ vector(count, idf)).max()))
    floor = 0.0
    for k in range(_CLASSES):
        floor = lowest[k] = lowest[k] * REJECT_SHARE if np.isfinite(lowest[k]) else floor
    return lowest


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(count) * idf
    return v / (np.linalg.norm(v) or 1.0)


@dataclass
class Model:
    """Centroids are rows of unit length; langs go with them, and floors: per centroid, the lowest cosine that is accepted
    for a text of each size class."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected). Null texts and texts without a letter: (und, 0, rejected)."""
        count = counts(text)
        if count is None or not self.langs:
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ vector(count, self.idf).astype(np.float32)
        best = int(cosine.argmax())
        return self.langs[best], float(min(1.0, max(0.0, cosine[best]))), bool(cosine[best] < self.floors[best, _size_class(count)])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, n): in how many texts of the partition each bin occurs; bin -1 counts texts."""
    found, n = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for x in batch.column(0):
            count = counts(x.as_py())
            if count is not None:
                found += count > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BINS)), pa.array(np.r_[n, found])], ["bin", "n"])


def _packed(count: np.ndarray) -> bytes:
    """Bins that occur, and how often."""
    at = np.flatnonzero(count)
    return at.astype("<u2").tobytes() + count[at].astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n, out = len(data) // 6, np.zeros(BINS)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<u4", n, 2 * n)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, head, counts) of rows (text, lang, h) whose text has a letter: what clustering needs, of bounded size."""
    for batch in slices(batches):
        made = [(lang.as_py(), h.as_py(), text.as_py()[: EXCERPTS[-1]], _packed(c)) for text, lang, h in zip(*batch.columns, strict=True) if (c := counts(text.as_py())) is not None]
        cols = zip(*made, strict=True) if made else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["lang", "h", "head", "counts"])


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from texts that are far from each other; always the same for the same rows."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        mine = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[mine == j].sum(axis=0) if (mine == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """Learn from the rows with a text and a lang. Only the centroids' sample is bounded: the texts of each language with
    the smallest hash of order_col (of the text, where that is null), at most `sample` of them; rows that repeat the hash
    count once. No usable row: a model that knows no language."""
    key = F.when(F.col(order_col).isNotNull(), F.xxhash64(F.col(order_col).cast("string"))).otherwise(F.xxhash64(F.lit(1), F.col(text_col)))
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), key.alias("h"))
    found = {r["bin"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    n = found.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([found.get(b, 0) for b in range(BINS)]))) + 1e-3
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # as many as the model has languages
    shares = F.create_map(*[F.lit(x) for lang, m in sorted(per_lang.items()) for x in (lang, min(1.0, 4.0 * sample / m))]) if per_lang else F.create_map(F.lit(""), F.lit(1.0))
    # Only a few times the sample goes to the task of a language, however many rows it has and however long they are: what
    # goes is a text's counts and beginning, and rows of equal key go once.
    likely = rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.element_at(shares, F.col("lang")) * (1 << 30))
    small = likely.mapInArrow(_digests, "lang string, h long, head string, counts binary")
    once = small.groupBy("lang", "h").agg(F.min(F.struct("head", "counts")).alias("d")).select("lang", "h", "d.head", "d.counts")

    def cluster(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first = table.sort_by([("h", "ascending")]).slice(0, sample)
        made = [_unpacked(x.as_py()) for x in first.column("counts")]
        vectors = np.array([vector(c, idf) for c in made])
        centres = _cluster(vectors, k)
        floors = _floors(first.column("head").to_pylist(), made, idf, centres).tobytes()
        return pa.table({"lang": [key[0].as_py()] * len(centres), "floors": [floors] * len(centres), "centre": [c.astype(np.float32).tobytes() for c in centres]})

    got = sorted(map(tuple, once.groupBy("lang").applyInArrow(cluster, "lang string, floors binary, centre binary").collect()))
    centroids = np.array([np.frombuffer(r[2], np.float32) for r in got]).reshape(-1, BINS)
    return Model(idf, centroids, [r[0] for r in got], np.array([np.frombuffer(r[1]) for r in got]).reshape(-1, _CLASSES))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected in front of its own columns (which must not have these names)."""
    schema = "lang_pred string, lang_score double, lang_rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [shared.value.predict(x.as_py()) for x in batch.column(names.index(text_col))]
            cols = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns], ["lang_pred", "lang_score", "lang_rejected", *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, {own}")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine), rejected, for each row of docs (doc_id, text, lang).

    Learns from rows whose crc32(doc_id as text) mod 4 is not 2; a null doc_id counts as the text "null". Repeated rows
    stay, an empty table gives no rows, other columns are not read.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    made = predict(rows.select("doc_id", "text", "held_out"), model)
    return made.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
