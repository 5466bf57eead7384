"""Queries that train tokenizers and search over weights, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.operators import bpe, corpus, measure, runs, search, train
from wordloom.plans import corpus_queries as base
from wordloom.plans.text_queries import docs, sql_pretokens, sql_words
from wordloom.session import table
from wordloom.sources.cache import kept

VOCABULARY, LEAST = 200, 5
SWEEP, SWEEP_MERGES = (1.0, 2.0, 4.0, 6.0), 20


def _inputs(spark, sf_dir):
    rows = docs(spark, sf_dir)
    weights = base._lang_weights(spark).crossJoin(rows.select("source").distinct())  # four languages
    pages = table(spark, sf_dir, "benchmark").select(F.lit("en").alias("lang"), "text")
    return rows, weights, pages


def _small(**more) -> train.Config:
    return train.Config(**{"vocab_size": VOCABULARY, "akshara": True, "alpha_min": base.FEW, "min_frequency": LEAST * corpus.MICRO, **more})


def trained_tokenizer(spark, sf_dir):
    """A tokenizer over all languages with weights, aksharas first, the benchmark's characters kept."""
    rows, weights, pages = _inputs(spark, sf_dir)
    return train.train(rows, weights, _small(), pages).vocabulary(spark)


def tokenizer_10k(spark, sf_dir):
    """The full training: 10,000 tokens over all languages and words."""
    return _full_parts(spark, sf_dir)[0]


def _full(spark, sf_dir):
    """(part, place, a, b): the tokens and kinds, and the merges, of the full training; trained once per session and state of
    the files."""
    def build():
        rows, weights, pages = _inputs(spark, sf_dir)
        made = train.train(rows, weights, train.Config(akshara=True), pages)
        return made.vocabulary(spark).select(F.lit("token").alias("part"), F.col("id").alias("place"), F.col("token").alias("a"), F.col("kind").alias("b")).unionByName(made.merge_table(spark).select(F.lit("merge").alias("part"), F.col("rank").cast("long").alias("place"), F.col("left").alias("a"), F.col("right").alias("b")))

    return kept(spark, ("tokenizer_10k", sf_dir), [f"{sf_dir}/{x}.parquet" for x in ("documents", "benchmark")], build)


def _full_parts(spark, sf_dir):
    """Its vocabulary, merges and alphabet."""
    made = _full(spark, sf_dir)
    vocab = made.where("part = 'token'").select(F.col("place").alias("id"), F.col("a").alias("token"), F.col("b").alias("kind"))
    merges = [(r.a, r.b) for r in made.where("part = 'merge'").orderBy("place").collect()]
    return vocab, merges, {r.token for r in vocab.where("kind = 'char'").collect()}


def documents_10k(spark, sf_dir):
    """Each document by the full tokenizer: tokens, unknown ones, a hash of its ids, and whether they decode to its text."""
    vocab, merges, alphabet = _full_parts(spark, sf_dir)
    ids = {r.token: r.id for r in vocab.collect()}
    norm = docs(spark, sf_dir).select("doc_id", text.normalized(F.coalesce("text", F.lit(""))).alias("norm"))
    words = text.pretokens(F.col("norm"))
    cut = norm.select("doc_id", "norm", F.flatten(bpe.encoded(words, merges, alphabet, ids=ids)).alias("cut")).select("doc_id", "norm", F.col("cut.token").alias("tokens"), F.col("cut.id").alias("ids"))
    unknown = F.size(F.filter("ids", lambda i: i == ids[bpe.UNKNOWN]))
    return cut.select("doc_id", F.size("ids").alias("n_tokens"), unknown.alias("unk"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), (bpe.decoded(F.col("tokens")) == F.col("norm")).alias("ok"))


def fertility_10k(spark, sf_dir):
    """Tokens, words, unknown characters and fertility of the full tokenizer, by language."""
    _, merges, alphabet = _full_parts(spark, sf_dir)
    return measure.evaluate(docs(spark, sf_dir), merges, ("lang",), alphabet, counts=base._measured(spark, sf_dir)).drop("violations")


def heldout_fertility_10k(spark, sf_dir):
    """The same by language and split."""
    _, merges, alphabet = _full_parts(spark, sf_dir)
    title = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    rows = docs(spark, sf_dir).select("lang", "text", text.split_name(title).alias("split"))
    return measure.evaluate(rows, merges, ("lang", "split"), alphabet).drop("violations")


def rounded_training(spark, sf_dir):
    """The same tokenizer from masses that are scaled and rounded word by word."""
    rows, weights, pages = _inputs(spark, sf_dir)
    return train.train(rows, weights, _small(total_mass=6_000_000, min_frequency=LEAST), pages).vocabulary(spark)


def recorded_run(spark, sf_dir):
    """What a training run writes into the ledger, but for times and hashes."""
    rows, weights, pages = _inputs(spark, sf_dir)
    made = runs.one_run(rows, weights, _small(), pages, "A-test")
    e = F.col("result.eval")["en"]
    return made.select("id", "stage", F.col("info.n_base_chars").cast("long").alias("chars"), F.col("info.n_learned").cast("long").alias("learned"), F.col("result.vocab_size").cast("long").alias("vocab_size"), e["tokens"].cast("long").alias("tokens"), e["words"].cast("long").alias("words"), e["unk"].cast("long").alias("unk"), F.col("result.spread").alias("spread"), "checks.*")


def configuration_grid(spark, sf_dir):
    """Tokens per configuration on the benchmark: as is, punctuation apart, bytes for unknown characters, fewer characters."""
    rows, weights, pages = _inputs(spark, sf_dir)
    configs = {"plain": _small(akshara=False), "punctuation": _small(punctuation=True), "bytes": _small(byte_fallback=True, vocab_size=VOCABULARY + 256), "few": _small(alpha_min=100 * base.FEW)}
    made = runs.grid(rows, weights, configs, pages)
    return made.select("stage", F.col("result.eval")["en"]["tokens"].alias("tokens"), F.col("result.vocab_size").alias("vocab_size"), "checks.no_unk_on_eval", "checks.roundtrip_eval")


def made_weights(spark, sf_dir):
    """Weights by language and source from multipliers, with both sources and with one."""
    counts = {r.lang: r.n / 8 for r in docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = [(name, key, w) for name, both in (("both", (3.0, 0.5)), ("eval", (1.0, 0.0))) for key, w in search.make_weights(counts, *both).items()]
    return spark.createDataFrame(rows, "name string, key string, weight double")


def weight_sweep(spark, sf_dir):
    return search.sweep(base._counts(spark, sf_dir), list(SWEEP), "en", SWEEP_MERGES)


def climbing_chains(spark, sf_dir):
    return search.chains(base._counts(spark, sf_dir), [1, 2], 4, 40)


def balanced_weights(spark, sf_dir):
    """Rounds of balancing the languages' weights, a row per round and language."""
    langs = sorted(x for x, _ in base.WEIGHTS)
    records = search.balance(search.spark_trial(base._counts(spark, sf_dir).where(F.col("lang").isin(*langs)), 40), langs, rounds=4)
    rows = [(r["trial"], x, r["multipliers"][x], r["fertility"][x], r["objective"], r["improved"]) for r in records for x in langs]
    return spark.createDataFrame(rows, "trial int, lang string, weight double, fertility double, objective double, improved boolean")


QUERIES = {f.__name__: f for f in (trained_tokenizer, tokenizer_10k, documents_10k, fertility_10k, heldout_fertility_10k, rounded_training, recorded_run, configuration_grid, made_weights, weight_sweep, climbing_chains, balanced_weights)}

_KEPT = f"""k as (select ch from (select unnest(string_split(word, '')) as ch, mass from x) group by ch having sum(mass) >= {base.FEW * corpus.MICRO} union select distinct ch from (select unnest(string_split(word, '')) as ch from (select unnest({sql_pretokens('text')}) as word from benchmark))),
bad as (select distinct word from (select word, unnest(string_split(word, '')) as ch from x) where ch not in (select ch from k)),
y as materialized (select word, mass from x where word not in (select word from bad)),
c as (select distinct unnest(string_split(word, '')) as token from y)"""


def _trained(words: str, least: int) -> str:
    """CTEs up to m2, the merges that fit, and v, the vocabulary. No product comes twice in so few merges."""
    return f"""with recursive {base._WORDS}, {base._MASS}, {_KEPT}, {base._learned(VOCABULARY, words, least)},
m2 as materialized (select * from m where rank < {VOCABULARY} - 1 - (select count(*) from c)),
v as (select (row_number() over (order by sect, place, token) - 1)::bigint as id, token, kind from (
  select 0 as sect, 0 as place, '<unk>' as token, 'special' as kind union all select 1, 0, token, 'char' from c union all select 2, rank, "left" || "right", 'learned' from m2))"""


_SCALED = "select word, floor(mass::double * (6000000::double / (select sum(mass) from y)::double) + ('0x' || substr(md5(word), 1, 8))::bigint / 4294967296::double)::bigint as n from y"
_CROSS = f"""q as materialized (select weight, word, sum(n * case when lang = 'en' then weight else 1 end * 1000000)::hugeint as n from w, (select unnest([{', '.join(str(int(p)) for p in SWEEP)}]) as weight) group by 1, 2),
e as materialized (select weight, row_number() over () as id, word, string_split(word, '') as s, n from q),
t(step, weight, id, word, s, n, l, r) as (
  select 0, weight, id, word, s, n, ''::varchar, ''::varchar from e
  union all
  select t.step + 1, t.weight, t.id, t.word, {base._joined('t.s', 'b.l', 'b.r')}, t.n, b.l, b.r from t join (
    select weight, l, r from (select weight, p[1] as l, p[2] as r, sum(n) as c from (select weight, unnest(list_zip(s[1:len(s) - 1], s[2:len(s)])) as p, n from t where len(s) > 1) group by 1, 2, 3)
    qualify row_number() over (partition by weight order by c desc, l, r) = 1) as b on b.weight = t.weight where t.step < {SWEEP_MERGES})"""

ORACLES = {
    "trained_tokenizer": f"{_trained('select word, mass as n from y', LEAST * corpus.MICRO)} select id, token, kind from v",
    "rounded_training": f"{_trained(f'select word, n from ({_SCALED}) where n > 0', LEAST)} select id, token, kind from v",
    "recorded_run": f"""{_trained('select word, mass as n from y', LEAST * corpus.MICRO)}, {base._BENCH},
ch as (select word, unnest(string_split(word, '')) as x, unnest(range(length(word))) as i from (select distinct word from bw)),
z(step, word, s) as (select 0, word, s from (select word, list(case when token is null then '<unk>' else x end order by i) as s from ch left join c on token = x group by word) union all
  select z.step + 1, z.word, {base._joined('z.s', 'm2."left"', 'm2."right"')} from z join m2 on m2.rank = z.step),
f as (select word, len(s) as t, len(list_filter(s, lambda x: x = '<unk>')) as u from z where step = (select count(*) from m2)),
p as (select sum(t)::bigint as tokens, sum(u)::bigint as unk from bw join f using (word))
select 'A-test-001' as id, 'A-test' as stage, (select count(*) from c) as chars, (select count(*) from m2) as learned, (select count(*) from v) as vocab_size, tokens, (select sum({sql_words('text')})::bigint from benchmark) as words, unk, 0.0::double as spread,
  (select count(*) from v) = 10000 as vocab_is_10000, unk = 0 as no_unk_on_eval, unk = 0 as roundtrip_eval from p""",
    "made_weights": "with l as (select lang, count(*) / 8.0 as n from documents group by lang) select name, lang || s as key, (n * w)::double as weight from l, (values ('both', '.eval', 3.0), ('both', '.train', 0.5), ('eval', '.eval', 1.0)) as v(name, s, w)",
    "weight_sweep": f"""with recursive {base._WORDS}, {_CROSS}, z as (select weight, word, len(s) as k from t where step = {SWEEP_MERGES})
select weight::double as weight, lang, sum(n * k)::double / sum(n)::double as fertility from w join z using (word) group by 1, 2""",
}
