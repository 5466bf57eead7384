"""Queries on a ledger of runs. Documents stand in for runs: a source is a stage, a document one of its runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import PYTHON_SPACE, count_words
from wordloom.operators import ledger
from wordloom.plans.text_queries import docs, sql_words
from wordloom.session import checkpointed

#: Every third run has held-out results, weights repeat by fives, tokenizers by fifties.
def runs(spark, sf_dir) -> DataFrame:
    words = F.col("_words").cast("double")
    fertility = ledger.ratio(F.col("n_chars").cast("double"), words)
    rows = docs(spark, sf_dir).select("source", "doc_id", "lang", "n_chars", count_words(F.col("text")).alias("_words")).select(
        F.col("source").alias("stage"),
        F.col("doc_id").alias("seq"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("id"),
        F.format_string("2026-%02d-%02dT%05d", F.col("doc_id") % 12 + 1, F.col("doc_id") % 28 + 1, F.col("doc_id") % 10000).alias("time"),
        "lang",
        fertility.alias("fertility"),
        F.abs(fertility - 6.0).alias("spread"),
        (F.col("doc_id") % 5).alias("key"),
        F.when(F.col("doc_id") % 3 == 0, fertility * 1.5).alias("heldout"),
        (F.col("n_chars") % 50).alias("tokenizer"),
        words.alias("weight"),
    )
    return rows


SQL = f"""r as (select source as stage, doc_id as seq, source || '-' || doc_id as id, printf('2026-%02d-%02dT%05d', doc_id % 12 + 1, doc_id % 28 + 1, doc_id % 10000) as time, lang,
n_chars::double / {sql_words('text')}::double as fertility, abs(n_chars::double / {sql_words('text')}::double - 6.0::double) as spread, doc_id % 5 as key,
case when doc_id % 3 = 0 then n_chars::double / {sql_words('text')}::double * 1.5::double end as heldout, n_chars % 50 as tokenizer, {sql_words('text')}::double as weight from documents)"""


def ledger_best_per_stage(spark, sf_dir):
    rows = runs(spark, sf_dir)
    counts = rows.groupBy("stage").agg(F.count("*").alias("runs"), F.countDistinct("tokenizer").alias("tokenizers"))
    return ledger.best_runs(rows, seq="seq").join(counts, "stage").select("stage", "id", "spread", "runs", "tokenizers")


def ledger_best_with_heldout(spark, sf_dir):
    rows = runs(spark, sf_dir)
    best = ledger.best_runs(rows, seq="seq")
    return ledger.with_heldout(best, rows, "key", F.col("heldout")).select("stage", "id", "spread", "key", "held")


def ledger_trace_best_so_far(spark, sf_dir):
    return ledger.trace(runs(spark, sf_dir), F.lit(True))


def ledger_elasticity(spark, sf_dir):
    made = ledger.elasticity(runs(spark, sf_dir), ("stage",))
    return made.select("stage", "seq", F.round("raw", 6).alias("raw"), F.round("smoothed", 6).alias("smoothed"))


def ledger_failure_streaks(spark, sf_dir):
    made = ledger.failure_streaks(runs(spark, sf_dir), ("stage",))
    return made.select("stage", "seq", "improved", F.col("fails").cast("long").alias("fails"), F.round("sigma", 9).alias("sigma"))


def ledger_next_ids(spark, sf_dir):
    return ledger.next_ids(runs(spark, sf_dir)).select("id", "run_id")


#: Stages of a ledger in its full schema, by doc_id modulo 4, with the display names of those that a report shows.
NAMES = (("C-src1", "one", ""), ("C-src2", "two", "could not be balanced"), ("C-src3", "three", "kept"), ("B-en", "reference", "stage B"), ("C-none", "absent", ""))


def full_ledger(spark, sf_dir) -> DataFrame:
    """Documents as runs of a ledger in its schema: four languages each, of which the fourth and the stage follow from the
    document; every third run has held-out results, weights repeat by fives."""
    words = F.col("_words")
    fourth, k = F.concat(F.lit("x"), "lang"), F.col("doc_id")
    stage = F.when(k % 4 == 0, F.concat(F.lit("B-"), "lang")).when(k % 4 == 1, F.concat(F.lit("C-"), "source")).when(k % 4 == 2, F.lit("D-sweep")).otherwise(F.concat(F.lit("D-ft"), (k % 3).cast("string")))
    langs = F.array(F.lit("en"), F.lit("fr"), F.lit("de"), fourth)
    factors = (F.lit(1.0), F.lit(1.1), F.lit(0.9), F.lit(1.0) + (k % 7).cast("double") / 10.0)

    def by_lang(scale: float) -> Column:
        each = [F.struct(x.alias("key"), F.struct(F.col("n_chars").cast("int").alias("tokens"), words.cast("int").alias("words"), (F.col("f") * scale * g).alias("fertility"), (k % 3).cast("int").alias("unk"), (k % 5 + n).cast("int").alias("akshara_violations")).alias("value")) for n, (x, g) in enumerate(zip((F.lit("en"), F.lit("fr"), F.lit("de"), fourth), factors, strict=True))]
        return F.map_from_entries(F.array(*each))

    values = [F.col("f") * g for g in factors]
    held = k % 3 == 0
    # A text is counted once: a condition on f would be pushed below, and count it again.
    some = docs(spark, sf_dir).where((F.col("n_chars") > 0) & F.col("text").rlike(f"[^{PYTHON_SPACE}]"))
    rows = some.select("doc_id", "lang", "source", "n_chars", count_words(F.col("text")).alias("_words")).withColumn("f", F.col("n_chars").cast("double") / F.col("_words").cast("double"))
    return rows.select(
        k.alias("seq"),
        F.concat(stage, F.lit("-"), k.cast("string")).alias("id"),
        stage.alias("stage"),
        F.format_string("2026-%02d-%02dT00:00:00", k % 12 + 1, k % 28 + 1).alias("time"),
        langs.alias("langs"),
        F.map_from_entries(F.array(*[F.struct(F.concat(x, F.lit(".eval")).alias("key"), (k % 5 + n).cast("double").alias("value")) for n, x in enumerate((F.lit("en"), fourth))])).alias("weights"),
        F.struct((k % 11).cast("int").alias("n_base_chars"), (k % 13).cast("int").alias("n_stage1"), (k % 17).cast("int").alias("n_learned")).alias("info"),
        F.struct(by_lang(1.0).alias("eval"), F.map_filter(by_lang(1.5), lambda _, m: held).alias("heldout"), F.greatest(*values).alias("max_fertility"), F.least(*values).alias("min_fertility"), (F.greatest(*values) - F.least(*values)).alias("spread"), (F.lit(1000.0) / (F.greatest(*values) - F.least(*values))).alias("score"), F.when(held, F.greatest(*[v * 1.5 for v in values])).alias("heldout_max")).alias("result"),
        F.when(held, F.concat(F.lit("it"), k.cast("string"), F.lit(" best+heldout"))).otherwise(F.concat(F.lit("en x"), (F.lit(1.0) + (k % 40).cast("double") / 8.0).cast("string"))).alias("note"),
    )


def ledger_stage_rows(spark, sf_dir):
    return ledger.stage_rows(full_ledger(spark, sf_dir))


def ledger_fourth_languages(spark, sf_dir):
    """Candidates for a fourth language with their pages' words, by level."""
    pages = docs(spark, sf_dir).groupBy(F.concat(F.lit("x"), "lang").alias("lang"), F.upper("lang").alias("name")).agg(F.sum(count_words(F.col("text"))).cast("int").alias("words"))
    limit = F.broadcast(pages.agg(F.avg("words").alias("mean")))  # one row
    rows = ledger.fourth_language_rows(full_ledger(spark, sf_dir), pages.crossJoin(limit).select("lang", "name", F.when(F.col("words") >= F.col("mean"), 2000).otherwise(1999).alias("words")))
    return rows.select("stage", "fourth", "name", "words", "eligible", "level", "best_id")


def ledger_ablations(spark, sf_dir):
    """Ablations that have a display name, with notes on large spreads, the final one marked."""
    rows = ledger.ablation_rows(full_ledger(spark, sf_dir), spark.createDataFrame(NAMES, "stage string, name string, note string"), reference="B-en", final="C-src1")
    return rows.select("stage", "name", "note", "level", "chosen", "runs")


def ledger_tradeoff(spark, sf_dir):
    """Sweep points by weight with the worst other language."""
    return ledger.tradeoff(full_ledger(spark, sf_dir), "D-sweep")


def ledger_tradeoff_places(spark, sf_dir):
    """Sweep points in the order in which the trade-off lists them."""
    rows = ledger.tradeoff(full_ledger(spark, sf_dir), "D-sweep")
    return rows.select("id", F.row_number().over(Window.orderBy("weight", "id")).cast("long").alias("place"))  # a sweep's points


def ledger_markdown(spark, sf_dir):
    """A report of the stages as a Markdown table, a line a row; no score where there is no spread."""
    rows = full_ledger(spark, sf_dir).groupBy("stage").agg(F.count("*").alias("n"), F.max(F.when(F.col("stage") != "D-sweep", F.col("result.spread"))).alias("spread")).orderBy("stage")
    lines = ledger.markdown(rows, [("stage", "Stage", None), ("n", "Runs", "%,d"), ("spread", "Spread", "%.3f")]).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "at long, line string")


def ledger_first_within(spark, sf_dir):
    """The first sweep point whose own fertility is small enough."""
    # Two numbers a point are kept: a condition on a fertility would be pushed below, and count a text for each use of its words.
    points = checkpointed(ledger.sweep_points(full_ledger(spark, sf_dir), "D-sweep").select("weight", "own"))
    limit = points.agg(F.avg("own")).first()[0] or 0.0
    return points.where(F.col("own") <= limit).groupBy().agg(F.min("weight").alias("weight"), F.count("*").alias("n_within"))


def ledger_last_noted(spark, sf_dir):
    """Each stage's baseline by its note: the last run that was measured on held-out texts."""
    noted = full_ledger(spark, sf_dir).where(F.contains("note", F.lit("best+heldout")))
    return noted.groupBy("stage").agg(F.max_by("id", "seq").alias("id"), F.max("seq").alias("seq"))


def ledger_heldout_totals(spark, sf_dir):
    """Words, tokens, unknown tokens, cuts and dates over the held-out languages of each run, and what they add up to by stage."""
    each = full_ledger(spark, sf_dir).where(ledger.has_heldout()).select("stage", F.substring("time", 1, 10).alias("date"), F.explode("result.heldout").alias("lang", "m"))
    sums = [F.sum(F.col(f"m.{c}")).alias(c) for c in ("words", "tokens", "unk", "akshara_violations")]
    return each.groupBy("stage").agg(*sums, F.max("date").alias("last_date"), F.max("m.fertility").alias("max_fertility"), (F.max("m.fertility") - F.min("m.fertility")).alias("spread"))


def ledger_languages_by_weight(spark, sf_dir):
    """Languages by falling weight, and by rising fertility, of each stage's best run."""
    runs_ = full_ledger(spark, sf_dir).withColumn("spread", F.col("result.spread"))
    best = ledger.best_runs(runs_)
    weights = F.transform(F.array_sort(F.transform(F.map_entries("weights"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k")))), lambda x: x["k"])
    fertile = F.transform(F.array_sort(F.transform(F.map_entries("result.eval"), lambda e: F.struct(e["value"]["fertility"].alias("f"), e["key"].alias("k")))), lambda x: x["k"])
    return best.select("stage", F.array_join(weights, ",").alias("by_weight"), F.array_join(fertile, ",").alias("by_fertility"))


def ledger_run_lines(spark, sf_dir):
    """One line of text per best run: fertilities, spread and score."""
    best = ledger.best_runs(full_ledger(spark, sf_dir).withColumn("spread", F.col("result.spread")))
    values = F.transform_values("result.eval", lambda _, m: F.floor(m["fertility"] * 16) / 16)
    return best.select("stage", ledger.run_line(values, F.floor(F.col("spread") * 16) / 16, F.floor(F.col("result.score")).cast("double")).alias("line"))


def ledger_by_language(spark, sf_dir):
    """Level, extremes and their languages of each stage, from the greatest fertility per language; runs without a language are a
    group without a name, and an unknown fertility is above all others."""
    means = runs(spark, sf_dir).groupBy("stage", "lang").agg(F.max("fertility").alias("top"))
    order = F.when(F.col("lang").isNotNull(), F.struct(F.col("top").isNull(), "top", "lang"))
    return means.groupBy("stage").agg(F.max("top").alias("max_fertility"), F.max_by("lang", order).alias("max_lang"), F.min("top").alias("min_fertility"), F.min_by("lang", order).alias("min_lang"), F.count("*").alias("n_langs"))


QUERIES = {
    f.__name__: f
    for f in (ledger_best_per_stage, ledger_best_with_heldout, ledger_trace_best_so_far, ledger_elasticity, ledger_failure_streaks, ledger_next_ids, ledger_by_language)
    + (ledger_stage_rows, ledger_fourth_languages, ledger_ablations, ledger_tradeoff, ledger_tradeoff_places, ledger_markdown, ledger_first_within, ledger_last_noted, ledger_heldout_totals, ledger_languages_by_weight, ledger_run_lines)
}

_BEST = "b as (select * from r qualify row_number() over (partition by stage order by spread, seq) = 1)"
_FULL = f"""r as (select doc_id as seq, case when doc_id % 4 = 0 then 'B-' || lang when doc_id % 4 = 1 then 'C-' || source when doc_id % 4 = 2 then 'D-sweep' else 'D-ft' || doc_id % 3 end as stage, printf('2026-%02d-%02dT00:00:00', doc_id % 12 + 1, doc_id % 28 + 1) as time,
'x' || lang as fourth, n_chars, {sql_words('text')} as w, n_chars::double / {sql_words('text')}::double as f, 1.0::double + (doc_id % 7)::double / 10.0::double as g, doc_id % 3 = 0 as held, doc_id as k from documents where n_chars > 0 and {sql_words('text')} > 0),
v as (select *, stage || '-' || k as id, [f * 1.0::double, f * 1.1::double, f * 0.9::double, f * g] as fs, [f * 1.5::double * 1.0::double, f * 1.5::double * 1.1::double, f * 1.5::double * 0.9::double, f * 1.5::double * g] as hs,
  case when held then 'it' || k || ' best+heldout' else 'en x' || (1.0::double + (k % 40)::double / 8.0::double) end as note from r),
l as (select *, list_max(fs) - list_min(fs) as spread, 4 * (k % 5) + 6 as cuts, (0.0::double + fs[1] + fs[2] + fs[3] + fs[4]) / 4::double as level, (0.0::double + hs[1] + hs[2] + hs[3] + hs[4]) / 4::double as mean, list_max(list_transform(fs, lambda x: x * 1.5::double)) as top from v),
b as (select * from l qualify row_number() over (partition by stage order by spread, seq) = 1)"""
_HELD = """h as (select b.stage, coalesce((select max(seq) from l where l.stage = b.stage and l.held and l.k % 5 = b.k % 5 and l.fourth = b.fourth), (select max(seq) from l where l.stage = b.stage and l.held)) as hseq from b),
s as (select b.stage, b.fourth, b.level, list_max(b.fs) as max, b.spread, l.top as heldout, list_contains([l.fourth], b.fourth) as same, b.fourth as bf, l.fs as lf, l.hs as lhs, l.fourth as lfourth, l.mean as lmean, b.cuts as akv_eval, l.cuts as akv_heldout,
  b.k % 11 as chars, b.k % 13 as stage1, b.k % 17 as learned, (select count(*) from l as c where c.stage = b.stage) as runs, b.id as best_id from b join h using (stage) left join l on l.stage = b.stage and l.seq = h.hseq)"""

ORACLES = {
    "ledger_best_per_stage": f"with {SQL}, {_BEST}, c as (select stage, count(*) as runs, count(distinct tokenizer) as tokenizers from r group by stage) select b.stage, id, spread, runs, tokenizers from b join c using (stage)",
    "ledger_best_with_heldout": f"with {SQL}, {_BEST} select b.stage, b.id, b.spread, b.key, coalesce((select arg_max(heldout, seq) from r where r.stage = b.stage and r.key = b.key and heldout is not null), (select arg_max(heldout, seq) from r where r.stage = b.stage and heldout is not null)) as held from b",
    "ledger_trace_best_so_far": f"with {SQL}, t as (select (row_number() over (order by time, id))::int as step, id, spread from r) select step, id, spread, min(spread) over (order by step) as best from t where spread > 0",
    "ledger_elasticity": f"""with {SQL}, d as (select stage, seq, ln(fertility) - ln(lag(fertility) over w) as df, ln(weight) - ln(lag(weight) over w) as dw from r window w as (partition by stage order by seq)),
e as (select stage, seq, case when abs(dw) > 1e-3 then df / dw end as raw from d), u as (select *, list(case when raw > -2 and raw < -0.005 then raw end) over (partition by stage order by seq) as past from e)
select stage, seq, round(raw, 6) as raw, round(list_reduce(list_prepend(-0.15::double, list_filter(past, lambda x: x is not null)), lambda s, x: s * 0.5 + x * 0.5), 6) as smoothed from u""",
    "ledger_failure_streaks": f"""with {SQL}, i as (select stage, seq, coalesce(spread < min(spread) over (partition by stage order by seq rows between unbounded preceding and 1 preceding), true) as improved from r),
g as (select *, sum(improved::int) over (partition by stage order by seq) as island from i), f as (select *, row_number() over (partition by stage, island order by seq) - 1 as fails from g)
select stage, seq, improved, fails, round(greatest(0.0002::double, 0.01::double * pow(0.6::double, sum((fails > 0 and fails % 3 = 0)::int) over (partition by stage order by seq))), 9) as sigma from f""",
    "ledger_next_ids": f"with {SQL} select id, stage || '-' || lpad((row_number() over (partition by stage order by seq))::varchar, 3, '0') as run_id from r",
    "ledger_by_language": f"with {SQL}, m as (select stage, lang, max(fertility) as top from r group by 1, 2) select stage, max(top) as max_fertility, max_by(lang, (top, lang)) as max_lang, min(top) as min_fertility, min_by(lang, (top, lang)) as min_lang, count(*) as n_langs from m group by stage",
    "ledger_stage_rows": f"with {_FULL}, {_HELD} select stage, fourth, level, max, spread, heldout, case when same then lmean end as heldout_mean, akv_eval::int as akv_eval, akv_heldout::int as akv_heldout, chars::int as chars, stage1::int as stage1, learned::int as learned, runs, best_id from s",
    "ledger_fourth_languages": f"with {_FULL}, p as (select 'x' || lang as fourth, upper(lang) as name, sum({sql_words('text')})::bigint as words from documents group by 1, 2), q as (select fourth, name, case when words >= (select avg(words) from p) then 2000 else 1999 end as words from p) select stage, fourth, name, words, words >= 2000 as eligible, level, id as best_id from b join q using (fourth) where starts_with(stage, 'B-')",
    "ledger_ablations": f"with {_FULL}, n as (select * from (values {', '.join(map(str, NAMES))}) as v(stage, name, note)) select stage, name, case when spread > 0.01 and not contains(n.note, 'could not') then case when n.note <> '' then n.note || '; ' else '' end || printf('best spread only %.3f', spread) else n.note end as note, list_max(fs) as level, stage = 'C-src1' as chosen, (select count(*) from l as c where c.stage = b.stage) as runs from b join n using (stage)",
    "ledger_tradeoff_places": f"with {_FULL} select id, row_number() over (order by round(try_cast(regexp_extract(note, 'x([^x]*)$', 1) as double), 3) nulls first, id) as place from l where stage = 'D-sweep'",
    "ledger_markdown": f"""with {_FULL}, g as (select stage, count(*) as n, max(spread) filter (stage <> 'D-sweep') as spread from l group by stage)
select 0::bigint as at, '| Stage | Runs | Spread |' as line union all select 1, '|---|---|---|' union all select row_number() over (order by stage) + 1, '| ' || stage || ' | ' || format('{{:,}}', n) || ' | ' || coalesce(printf('%.3f', spread), '—') || ' |' from g""",
    "ledger_tradeoff": f"with {_FULL} select round(try_cast(regexp_extract(note, 'x([^x]*)$', 1) as double), 3) as weight, fs[1] as own, greatest(fs[2], fs[3], fs[4]) as worst_other, case when fs[2] >= fs[3] and fs[2] >= fs[4] then 'fr' when fs[3] >= fs[4] then 'de' else fourth end as worst_lang, spread, 1000.0::double / spread as score, id from l where stage = 'D-sweep'",
    "ledger_first_within": f"with {_FULL}, d as (select * from l where stage = 'D-sweep') select min(round(try_cast(regexp_extract(note, 'x([^x]*)$', 1) as double), 3)) as weight, count(*) as n_within from d where fs[1] <= (select avg(fs[1]) from d)",
    "ledger_last_noted": f"with {_FULL} select stage, max_by(id, seq) as id, max(seq) as seq from l where held group by stage",
    "ledger_heldout_totals": f"with {_FULL} select stage, sum(4 * w)::bigint as words, sum(4 * n_chars)::bigint as tokens, sum(4 * (k % 3))::bigint as unk, sum(cuts)::bigint as akshara_violations, max(time[1:10]) as last_date, max(list_max(hs)) as max_fertility, max(list_max(hs)) - min(list_min(hs)) as spread from l where held group by stage",
    "ledger_languages_by_weight": f"with {_FULL} select stage, fourth || '.eval,en.eval' as by_weight, array_to_string(list_transform(list_sort([{{'f': fs[1], 'k': 'en'}}, {{'f': fs[2], 'k': 'fr'}}, {{'f': fs[3], 'k': 'de'}}, {{'f': fs[4], 'k': fourth}}]), lambda x: x.k), ',') as by_fertility from b",
    "ledger_run_lines": f"""with {_FULL}, q as (select *, list_transform(fs, lambda x: floor(x * 16) / 16) as y, floor(spread * 16) / 16 as sp, floor(1000.0::double / spread)::double as sc from b)
select stage, printf('de %.4f en %.4f fr %.4f %s %.4f', y[3], y[1], y[2], fourth, y[4]) || printf('  spread %.5f  score ', sp) || format('{{:,.1f}}', sc) as line from q""",
}
