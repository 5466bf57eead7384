"""Mixing sources to target weights with a low-discrepancy schedule of equal blocks of words.

The mix is a sequence of numbered slots, each of which plays one block. The golden-ratio sequence gives each slot a point;
the sources' cumulative targets turn the point into a source, and the slot's rank within its source names the block that it
plays. So the schedule decides how many blocks a source has, by how many points fall on it, and where in the mix each of
them stands. The documents of a source are shuffled by a hash, laid end to end, over again up to the bound on repeats,
and cut into blocks of equal size. Joining blocks with slots on (source, rank) gives each document the words that the mix
takes from it and its places.

The schedule has about SLOTS slots at any size of the corpus, as the block grows with the mix; every prefix of it holds each
source's share up to a few blocks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.native import words_of
from wordloom.operators.prefix import ranged, with_offsets
from wordloom.session import checkpointed, scratch

#: Slots of a schedule, and least slots per source: what a mix is cut into.
SLOTS, SLOTS_PER_SOURCE = 1 << 20, 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: The golden ratio's fraction of 2^31, an odd number: slot i gets the point i * GOLDEN mod 2^31.
GOLDEN, POINTS = 1327217885, 1 << 31
BUCKETS = 4096
SLOT_CHUNK = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source_id, source, source_size, target, quota) from rows (source, size).

    Sources by code point, null last, take the weights in turn. level is what one unit of weight gets: a source whose
    share would pass `most` times its size stops there, and the rest is shared anew until none does. Each round sends two
    numbers to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    ranked = with_offsets(ranged(totals, ["_null", "source"]), [], ["_null", "source"], F.lit(1), "source_id")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    weighed = checkpointed(ranked.select("source_id", "source", "source_size", turn.cast("double").alias("weight")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, heft, level = share * total, 0.0, 0.0
    while True:
        full = F.lit(float(most)) * F.col("source_size") < F.lit(level) * F.col("weight")
        sums = weighed.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("s"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if not sums["w"]:
            break
        rest, heft = share * total - most * sums["s"], sums["w"]
        if rest / heft == level:
            break
        level = rest / heft
    full = F.lit(float(most)) * F.col("source_size") < F.lit(level) * F.col("weight")
    target = F.when(full, F.lit(float(most)) * F.col("source_size")).otherwise(F.col("weight") * F.lit(float(rest)) / F.lit(heft or 1.0))
    made = weighed.withColumn("target", target)
    return made.select("source_id", "source", "source_size", "target", F.least(F.lit(most) * F.col("source_size"), F.floor(F.col("target") + 1e-6)).cast("long").alias("quota"))


def schedule(targets: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, int, int]:
    """(source_id, rank, slot) for every slot of the mix, ranks without gaps, the words of a block, and the number of slots.

    The quotas laid end to end are a line, scaled to POINTS; slot i plays the source in which i * GOLDEN mod POINTS falls.
    A source without a point plays nothing.
    """
    begun = checkpointed(with_offsets(ranged(targets.select("source_id", "quota"), ["source_id"]), [], ["source_id"], F.col("quota"), "begin").select("source_id", "quota", "begin"))
    sums = begun.agg(F.sum("quota").alias("q"), F.count("*").alias("n")).first()
    line = sums["q"] or 0
    block = max(1, -(-line // max(slots, SLOTS_PER_SOURCE * sums["n"])))
    n = -(-line // block)
    scaled = [F.expr(f"cast(ceil(cast({c} as decimal(19,0)) * {POINTS} / {max(line, 1)}) as bigint)").alias(c) for c in ("begin", "begin + quota")]
    spans = begun.where("quota > 0").select("source_id", scaled[0], scaled[1].alias("end")).where("begin < end")
    width = POINTS // BUCKETS
    spread = spans.select("*", F.explode(F.sequence(F.expr(f"begin div {width}"), F.expr(f"(end - 1) div {width}"))).alias("bucket"))
    points = targets.sparkSession.range(n).select(F.col("id").alias("slot"), F.expr(f"id % {POINTS} * {GOLDEN} % {POINTS}").alias("at"))
    dealt = points.withColumn("bucket", F.expr(f"at div {width}")).join(spread, "bucket").where("at >= begin and at < end")
    chunked = dealt.select("source_id", "slot", F.expr(f"slot div {SLOT_CHUNK}").alias("_chunk"))
    return checkpointed(with_offsets(chunked, ["source_id"], ["slot"], F.lit(1), "rank").select("source_id", "rank", "slot")), block, n


def plays(rows: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, int]:
    """Rows (uid, doc_id, source, size, h) with source_id, source_size and target; and the plays of the mix, (uid, turn, size,
    words, slot, n_slots): the first `words` words of the row, from `slot` on, over n_slots slots;
    and the number of slots.

    h, a hash of what the row holds, shuffles the rows of a source; rows of equal h are taken to be equal.
    """
    rows = checkpointed(rows)  # cutting ranges reads its input twice
    laid = ranged(rows, ["source", "h", "uid"])
    starts = with_offsets(laid, ["source"], ["h", "uid"], F.col("size"), "begin")
    targets = checkpointed(source_targets(laid.select("source", "size")))
    scheduled, block, n = schedule(targets, slots)
    blocks = scheduled.groupBy("source_id").agg(F.count("*").alias("blocks"))
    ends = F.least(F.col("source_size") * MOST, F.coalesce("blocks", F.lit(0)) * block)
    played = checkpointed(targets.join(blocks, "source_id", "left").withColumn("played", ends).withColumnRenamed("source", "_source"))
    placed = checkpointed(starts.join(played, F.col("source").eqNullSafe(F.col("_source"))).select("uid", "doc_id", "source", "size", "source_id", "source_size", "target", "played", "begin"))
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(played - 1 - begin) div source_size")))
    shown = placed.where("size > 0 and begin < played").select("uid", "source_id", "size", "played", passes.alias("turn"), F.expr("begin + turn * source_size").alias("lo"))
    cut = shown.select("uid", "source_id", "turn", "size", F.expr("least(size, played - lo)").alias("words"), F.expr(f"lo div {block}").alias("rank"), F.expr(f"(least(lo + size, played) - 1) div {block} - lo div {block} + 1").alias("n_slots"))
    met = cut.join(scheduled.hint("merge"), ["source_id", "rank"])
    return placed, met.select("uid", "turn", "size", "words", "slot", "n_slots"), n


def _size(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _content(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_slots for each row of docs (doc_id, text, source).

    first_slot is the earliest slot that plays a word of the row (null: none), n_slots how many slots do. A null text has
    size 0 and is never taken; null sources form one source; null ids and repeated rows stay, each with its own taken; an
    empty table gives no rows; other columns are not read. The same rows give the same result, however they are read.
    """
    uid = F.monotonically_increasing_id().alias("uid")
    rows = docs.select(uid, F.col("doc_id").cast("long").alias("doc_id"), "source", _size(F.col("text")).alias("size"), _content(F.col("doc_id"), F.col("text")).alias("h"))
    placed, played, _ = plays(rows, slots)
    got = played.groupBy("uid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum("n_slots").alias("n_slots"))
    met = placed.join(got.hint("merge"), "uid", "left")
    return met.select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) if c != "first_slot" else F.col(c) for c in ("taken", "first_slot", "n_slots")])


def _keyed(docs: DataFrame) -> DataFrame:
    """(uid, row): docs' rows with a key that two reads agree on, however the files are split. Rows of a plain scan of files have
    their file and place in it; any others are numbered once, in a table in the shared folder."""
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if plan == "LogicalRelation" and docs.columns and "_metadata" not in docs.columns:
        place = F.concat_ws(":", F.md5("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
        try:
            return docs.select(place.alias("uid"), F.struct("*").alias("row"))
        except AnalysisException:  # a format without places
            pass
    path = scratch(docs.sparkSession, "mixed")
    docs.select(F.monotonically_increasing_id().cast("string").alias("uid"), F.struct("*").alias("row")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def mixed_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The documents of the mix in the order of their slots, as often as they are played: whole texts, and the first words of
    those that a source's end cuts. Columns are those of docs, n_chars (if there) brought up to date.

    Rows keep their keys between reads, see _keyed. Partitions are ranges of slots in ascending order, sorted inside. Null and
    wordless texts are never played; nulls in other columns, repeated rows, clashing names and empty tables are as in `mix`.
    """
    spark, kept = docs.sparkSession, _keyed(docs)
    text, doc_id = F.col("row.text"), F.col("row.doc_id").cast("long")
    _, played, n = plays(kept.select("uid", doc_id.alias("doc_id"), F.col("row.source").alias("source"), _size(text).alias("size"), _content(doc_id, text).alias("h")), slots)
    each = kept.join(played, "uid")
    part = F.col("words").cast("string")
    pattern = F.concat(F.lit("^[\\x20\\x09-\\x0D]*+(?:[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+){"), part, F.lit("}+"))
    whole = F.col("words") == F.col("size")
    made = {"text": F.when(whole, text).otherwise(F.call_function("regexp_extract", text, pattern, F.lit(0)))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(made["text"]).cast("long"))
    played_rows = each.select("slot", "uid", "turn", F.struct(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]).alias("out"))
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = played_rows.repartitionById(ways, F.expr(f"cast(slot * {ways}L div {max(n, 1)} as int)"))
    return dealt.sortWithinPartitions("slot", "uid", "turn").select("out.*")


#: DuckDB SQL of mix over documents, with a schedule of its own.
ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, source, md5(coalesce(doc_id::varchar, 'null') || ':' || coalesce(text, '')) as h,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from d group by source),
r as (select *, 2.0 * source_size / w as top, sum(source_size) over ()::double as total from s),
k as (select *, coalesce(sum(source_size) over (order by top, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as before,
             sum(w) over (order by top, source nulls last rows between current row and unbounded following) as heft from r),
l as (select min_by(1.5 * total - 2 * before, top) as rest, min_by(heft, top) as heft from k where 2.0 * source_size * heft >= w * (1.5 * total - 2 * before)),
t as (select r.source, source_size, case when 2.0 * source_size < l.rest / l.heft * w then 2.0 * source_size else w * l.rest / l.heft end::double as target from r, l),
u as (select *, least(2 * source_size, floor(target + 1e-6)::bigint)::bigint as quota from t),
q as (select *, coalesce(sum(quota) over (order by source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as start from u),
b as (select greatest(1, -(-sum(quota) // greatest({SLOTS}, {SLOTS_PER_SOURCE} * count(*))))::bigint as block, sum(quota)::bigint as line from q),
g as (select i as slot, (((i % {POINTS}) * {GOLDEN} % {POINTS})::hugeint * line // {POINTS})::bigint as at from b, range(-(-line // block)) as x(i)),
m as (select q.source, slot, row_number() over (partition by q.source order by slot) - 1 as rank from g join q on g.at >= q.start and g.at < q.start + q.quota),
c as (select q.source, source_size, target, least(2 * source_size, block * (select count(*) from m where m.source is not distinct from q.source))::bigint as played, block from q, b),
p as (select d.*, (sum(size) over (partition by source order by h, rid) - size)::bigint as a from d),
e as (select p.*, source_size, target, block, unnest([a, a + source_size]) as lo, played from p join c on c.source is not distinct from p.source),
f as (select rid, lo, least(lo + size, played) as hi, block, source from e where size > 0 and lo < played),
o as (select rid, sum(hi - lo)::bigint as taken, min(slot)::bigint as first_slot, sum((hi - 1) // block - lo // block + 1)::bigint as n_slots
      from f join m on m.source is not distinct from f.source and m.rank = lo // block group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot, coalesce(n_slots, 0)::bigint as n_slots
from p left join o using (rid) join c on c.source is not distinct from p.source
"""
