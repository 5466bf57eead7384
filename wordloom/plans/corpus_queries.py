"""Queries on the corpus and on tokenizers, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import script, text
from wordloom.operators import bpe, corpus, measure, merges
from wordloom.plans.text_queries import SQL_VARIANTS, docs, sql_norm, sql_pretokens, sql_words
from wordloom.session import checkpointed, table
from wordloom.sources.cache import kept

#: Micro-weights of the languages in the weighted queries; each source counts alike.
WEIGHTS = (("de", 2_000_000), ("en", 1_000_000), ("es", 2_500_000), ("fr", 1_500_000))
MERGES = 60
FEW = 30  # alphabet filter: least occurrences of a character


def _lang_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "lang string, micro long")


def _counts(spark, sf_dir) -> DataFrame:
    """Occurrences of every pre-token by language."""
    return _measured(spark, sf_dir).where("word is not null")


def _measured(spark, sf_dir) -> DataFrame:
    """Those, with the words of each language: counted once per session and state of the files, as every query here starts from them."""
    return kept(spark, ("word_counts", sf_dir), [f"{sf_dir}/documents.parquet"], lambda: measure.counted_with_words(docs(spark, sf_dir), ("lang",)))


def _all_words(spark, sf_dir) -> DataFrame:
    return _counts(spark, sf_dir).groupBy("word").agg(F.sum("n").alias("n"))


def _weighted(spark, sf_dir) -> DataFrame:
    return corpus.weighted_counts(_counts(spark, sf_dir), _lang_weights(spark), on=("lang",))


def pretoken_counts_topk(spark, sf_dir):
    return _all_words(spark, sf_dir).orderBy(F.desc("n"), "word").limit(50)


def pretoken_punct_counts(spark, sf_dir):
    """Pieces of pre-tokens by language, cut in distinct pre-tokens."""
    return _counts(spark, sf_dir).groupBy("lang").agg(F.sum(F.col("n") * F.size(text.punctuation_pieces(F.col("word")))).alias("n_pieces"))


def punct_floor_per_lang(spark, sf_dir):
    pieces = pretoken_punct_counts(spark, sf_dir)
    words = _measured(spark, sf_dir).where("word is null").groupBy("lang").agg(F.sum("n").alias("n_words"))
    return pieces.join(words, "lang").select("lang", (F.col("n_pieces").cast("double") / F.col("n_words").cast("double")).alias("floor"))


def weighted_word_counts(spark, sf_dir):
    return _weighted(spark, sf_dir).select("word", F.col("mass").cast("long").alias("mass"))


def positive_weights(spark, sf_dir):
    """Words by weights of which one is zero, one negative and one missing: the languages that are left."""
    given = spark.createDataFrame([("de", 0), ("en", 3), ("es", -1)], "lang string, micro long")
    return corpus.weighted_counts(_counts(spark, sf_dir), given, on=("lang",)).select("word", F.col("mass").cast("long").alias("mass"))


def rounded_word_counts(spark, sf_dir):
    return corpus.rounded_counts(_weighted(spark, sf_dir))


def char_frequency(spark, sf_dir):
    return corpus.characters(_weighted(spark, sf_dir)).select("char", F.col("mass").cast("long").alias("mass"))


def _eval_words(spark, sf_dir) -> DataFrame:
    return corpus.word_counts(table(spark, sf_dir, "benchmark"), keys=()).select("word")


def alphabet_filter(spark, sf_dir):
    """Words and occurrences that are left when rare characters are dropped, unless the benchmark has them."""
    counts = _counts(spark, sf_dir)
    words = counts.groupBy("word").agg(F.sum("n").alias("mass"))
    kept = corpus.alphabet_filtered(words, corpus.kept_characters(words, FEW, _eval_words(spark, sf_dir)))
    return counts.join(kept.select("word"), "word", "left_semi").groupBy("lang").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


def base_vocabulary_ids(spark, sf_dir):
    return corpus.base_vocabulary(_counts(spark, sf_dir).select("word"))


def adjacent_pair_counts(spark, sf_dir):
    return corpus.adjacent_pairs(_weighted(spark, sf_dir)).select("left", "right", F.col("mass").cast("long").alias("mass"))


def top_pairs_per_lang(spark, sf_dir):
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    sums = _counts(spark, sf_dir).select("lang", F.explode(pairs).alias("p"), "n").groupBy("lang", "p.left", "p.right").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "left", "right"))
    return sums.withColumn("rank", rank).where("rank <= 5").select("lang", "rank", "left", "right", "n")


def _merges(spark, sf_dir) -> DataFrame:
    return kept(spark, ("merges", sf_dir, MERGES), [f"{sf_dir}/documents.parquet"], lambda: merges.learn_merges_partitioned(_all_words(spark, sf_dir), MERGES))


def bpe_merges_first_n(spark, sf_dir):
    return merges.learn_merges_partitioned(_all_words(spark, sf_dir), MERGES)


def bpe_merges_relational(spark, sf_dir):
    return bpe.learn_merges_relational(_all_words(spark, sf_dir), 20)


def _vocabulary(spark, sf_dir) -> DataFrame:
    return bpe.vocabulary(corpus.base_vocabulary(_all_words(spark, sf_dir)), _merges(spark, sf_dir))


def bpe_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("id", "token", "kind")


def vocab_lineage(spark, sf_dir):
    """What each token was built from, by joining the vocabulary with the merges on the product."""
    products = _merges(spark, sf_dir).select(F.concat("left", "right").alias("token"), F.to_json(F.array("left", "right")).alias("built"))
    return _vocabulary(spark, sf_dir).select("id", "token").join(products, "token", "left").select("id", "token", F.coalesce("built", F.lit("")).alias("built_from"))


def vocab_script_facets(spark, sf_dir):
    rows = _vocabulary(spark, sf_dir)
    word = F.startswith("token", F.lit(text.META)) & (F.length("token") > 1)
    return rows.groupBy(script.script_of(F.col("token")).alias("script")).agg(F.count("*").alias("n_tokens"), F.count_if(word).alias("n_words"))


def vocab_page(spark, sf_dir):
    """The Latin tokens with an o, seven to a page: the last page, as the one that is asked for is past it."""
    rows = _vocabulary(spark, sf_dir).where(F.contains("token", F.lit("o")) & (script.script_of(F.col("token")) == "Latin"))
    return bpe.page(rows, "id", 99, 7).select("id", "token", F.length("token").cast("long").alias("code_points"))


def _table(spark, sf_dir) -> list[tuple[str, str]]:
    return [(r["left"], r["right"]) for r in _merges(spark, sf_dir).orderBy("rank").collect()]  # as large as the vocabulary


def bpe_encode_fertility(spark, sf_dir):
    return measure.evaluate(docs(spark, sf_dir), _table(spark, sf_dir), ("lang",), check_aksharas=False, counts=_measured(spark, sf_dir)).select("lang", "tokens", "words", "fertility")


def fertility_spread_score(spark, sf_dir):
    return measure.spread(bpe_encode_fertility(spark, sf_dir))


def unk_counts(spark, sf_dir):
    """Unknown characters per language for the alphabet of the benchmark."""
    alphabet = {r["token"] for r in corpus.base_vocabulary(_eval_words(spark, sf_dir)).where("kind = 'char'").collect()}
    return measure.evaluate(docs(spark, sf_dir), [], ("lang",), alphabet=alphabet, check_aksharas=False, counts=_measured(spark, sf_dir)).select("lang", "tokens", "unk")


def roundtrip_check(spark, sf_dir):
    """Whether each text of the benchmark survives, with an alphabet that lacks its second character: then it must not."""
    texts = table(spark, sf_dir, "benchmark")
    whole = measure.round_trip(texts, _table(spark, sf_dir), "item_id")
    alphabet = {chr(i) for i in range(32, 0x250)} - {"a"} | {text.META}
    lossy = measure.round_trip(texts, _table(spark, sf_dir), "item_id", alphabet)
    return whole.join(lossy.withColumnRenamed("ok", "ok_without_a"), "item_id")


def heldout_vs_train_fertility(spark, sf_dir):
    title = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    rows = docs(spark, sf_dir).select("lang", "text", text.split_name(title).alias("split"))
    return measure.evaluate(rows, _table(spark, sf_dir), ("lang", "split"), check_aksharas=False).select("lang", "split", "tokens", "words", "fertility")


def flat_token_ids(spark, sf_dir):
    """Every token of the benchmark's texts with its place and id; what the vocabulary does not know is <unk>."""
    vocab = checkpointed(_vocabulary(spark, sf_dir))
    alphabet = {r["token"] for r in vocab.where("kind = 'char'").collect()}
    pieces = text.pretokens(text.normalized(F.col("text")))
    return bpe.flat_tokens(table(spark, sf_dir, "benchmark").select("item_id", bpe.encoded(pieces, _table(spark, sf_dir), alphabet).alias("pieces")), vocab, "item_id")


def bpe_merges_full(spark, sf_dir):
    """Up to 1,000 merges per language over all words, of pairs of at least two occurrences, languages side by side."""
    return merges.learn_merges_by(_counts(spark, sf_dir), 1000, "lang", least=2)


QUERIES = {
    f.__name__: f
    for f in (pretoken_counts_topk, pretoken_punct_counts, punct_floor_per_lang, weighted_word_counts, positive_weights, rounded_word_counts, char_frequency, alphabet_filter, base_vocabulary_ids, adjacent_pair_counts, top_pairs_per_lang, bpe_merges_first_n, bpe_merges_relational, bpe_vocabulary, vocab_lineage, vocab_script_facets, vocab_page, bpe_encode_fertility, fertility_spread_score, unk_counts, roundtrip_check, heldout_vs_train_fertility, flat_token_ids, bpe_merges_full)
}

_WORDS = f"w as materialized (select lang, word, count(*)::bigint as n from (select lang, unnest({sql_pretokens('text')}) as word from documents) group by 1, 2)"
_MASS = "x as materialized (select word, sum(n * micro)::hugeint as mass from w join (values ('de', 2000000), ('en', 1000000), ('es', 2500000), ('fr', 1500000)) as v(lang, micro) using (lang) group by word)"
_PAIRS = "unnest(list_zip(string_split(word, '')[1:length(word) - 1], string_split(word, '')[2:length(word)]))"
_PIECES = r"(case when length(word) = 1 then 1 else len(regexp_extract_all(substr(word, 2), '[\p{P}\p{S}]+|[^\p{P}\p{S}]+')) end)"
_JOIN = "list_reduce(list_transform(s, lambda c: [c]), lambda o, c: case when o[-1] = l and c[1] = r then list_concat(o[1:len(o) - 1], [l || r]) else list_concat(o, c) end)"


def _joined(s: str, left: str, right: str) -> str:
    return f"case when list_contains({s}, {left}) and list_contains({s}, {right}) then list_reduce(list_transform({s}, lambda c: [c]), lambda o, c: case when o[-1] = {left} and c[1] = {right} then list_concat(o[1:len(o) - 1], [{left} || {right}]) else list_concat(o, c) end) else {s} end"


def _learned(n: int, words: str = "select word, sum(n)::hugeint as n from w group by word", least: int = 1, symbols: str = "string_split(word, '')") -> str:
    """CTEs: e (distinct words as symbols), t (rounds of merging) and m (rank, left, right, n)."""
    return f"""e as materialized (select row_number() over () as id, {symbols} as s, n from ({words})),
t(step, id, s, n, l, r, c) as (
  select 0, id, s, n, ''::varchar, ''::varchar, 0::hugeint from e
  union all
  select t.step + 1, t.id, {_joined('t.s', 'b.l', 'b.r')}, t.n, b.l, b.r, b.c from t, (
    select p[1] as l, p[2] as r, sum(n)::hugeint as c from (select unnest(list_zip(s[1:len(s) - 1], s[2:len(s)])) as p, n from t where len(s) > 1) group by 1, 2 having sum(n) >= {least} order by c desc, l, r limit 1) as b
  where t.step < {n}),
m as materialized (select distinct (step - 1)::int as rank, l as "left", r as "right", c::bigint as n from t where step > 0)"""


_RECURSIVE = f"with recursive {_WORDS}, {_learned(MERGES)}"
_BASE = """c as (select distinct unnest(string_split(word, '')) as token from w),
v as materialized (select (row_number() over (order by sect, place, token) - 1)::bigint as id, token, kind from (
  select 0 as sect, 0 as place, '<unk>' as token, 'special' as kind union all select 1, 0, token, 'char' from c union all select 2, rank, "left" || "right", 'learned' from m))"""


def _segmented(words: str, name: str = "f", n: int = MERGES) -> str:
    """CTEs: the distinct words of a query (word, s) cut by the merges in rank order: (word, s, t)."""
    return f"""{name}z(step, word, s) as (select 0, word, s from ({words}) union all
  select z.step + 1, z.word, {_joined('z.s', 'm."left"', 'm."right"')} from {name}z as z join m on m.rank = z.step),
{name} as materialized (select word, s, len(s)::bigint as t from {name}z where step = {n})"""


_CUT = _segmented("select distinct word, string_split(word, '') as s from w")
_FERT = f"""g as (select lang, sum(n * t)::bigint as tokens from w join f using (word) group by lang),
h as (select lang, sum({sql_words('text')})::bigint as words from documents group by lang),
i as (select lang, tokens, words, tokens::double / words::double as fertility from g join h using (lang))"""
_BENCH = f"bw as materialized (select item_id, unnest(range(len(p)))::bigint as word_at, unnest(p) as word from (select item_id, {sql_pretokens('text')} as p from benchmark))"

ORACLES = {
    "pretoken_counts_topk": f"with {_WORDS} select word, sum(n)::bigint as n from w group by word order by n desc, word limit 50",
    "pretoken_punct_counts": f"with {_WORDS} select lang, sum(n * {_PIECES})::bigint as n_pieces from w group by lang",
    "punct_floor_per_lang": f"with {_WORDS}, p as (select lang, sum(n * {_PIECES})::bigint as k from w group by lang), h as (select lang, sum({sql_words('text')})::bigint as words from documents group by lang) select lang, k::double / words::double as floor from p join h using (lang)",
    "weighted_word_counts": f"with {_WORDS}, {_MASS} select word, mass::bigint as mass from x",
    "positive_weights": f"with {_WORDS} select word, (3 * n)::bigint as mass from w where lang = 'en'",
    "rounded_word_counts": f"with {_WORDS}, {_MASS}, y as (select word, floor(mass::double * (6000000::double / sum(mass) over ()::double) + ('0x' || substr(md5(word), 1, 8))::bigint / 4294967296::double)::bigint as k from x) select word, k from y",
    "char_frequency": f"with {_WORDS}, {_MASS}, c as (select unnest(string_split(word, '')) as char, mass from x) select char, sum(mass)::bigint as mass from c group by char",
    "alphabet_filter": f"with {_WORDS}, c as (select unnest(string_split(word, '')) as ch, n from w), bw as (select distinct unnest({sql_pretokens('text')}) as word from benchmark), b as (select distinct unnest(string_split(word, '')) as ch from bw), k as (select ch from c group by ch having sum(n) >= {FEW} union select ch from b), x as (select distinct word from (select word, unnest(string_split(word, '')) as ch from w) where ch not in (select ch from k)) select lang, count(*) as n_words, sum(n)::bigint as n from w where word not in (select word from x) group by lang",
    "base_vocabulary_ids": f"with {_WORDS}, c as (select distinct unnest(string_split(word, '')) as token from w) select 0::bigint as id, '<unk>' as token, 'special' as kind union all select row_number() over (order by token), token, 'char' from c",
    "adjacent_pair_counts": f"with {_WORDS}, {_MASS}, p as (select {_PAIRS} as p, mass from x where length(word) > 1) select p[1] as \"left\", p[2] as \"right\", sum(mass)::bigint as mass from p group by 1, 2",
    "top_pairs_per_lang": f"with {_WORDS}, p as (select lang, {_PAIRS} as p, n from w where length(word) > 1), s as (select lang, p[1] as \"left\", p[2] as \"right\", sum(n)::bigint as n from p group by 1, 2, 3) select lang, (row_number() over (partition by lang order by n desc, \"left\", \"right\"))::int as rank, \"left\", \"right\", n from s qualify rank <= 5",
    "bpe_merges_first_n": f"{_RECURSIVE} select * from m",
    "bpe_merges_relational": f"with recursive {_WORDS}, {_learned(20)} select * from m",
    "bpe_vocabulary": f"{_RECURSIVE}, {_BASE} select * from v",
    "vocab_lineage": f"""{_RECURSIVE}, {_BASE} select id, token, case when rank is null then '' else '["' || "left" || '","' || "right" || '"]' end as built_from from v left join m on token = "left" || "right" """,
    "vocab_script_facets": f"{_RECURSIVE}, {_BASE} select SCRIPT as script, count(*) as n_tokens, count(*) filter (token like '▁_%') as n_words from v group by 1",
    "vocab_page": f"{_RECURSIVE}, {_BASE}, o as (select id, token from v where contains(token, 'o') and SCRIPT = 'Latin') select id, token, length(token)::bigint as code_points from o order by id limit 7 offset greatest(0, ((select count(*) from o) - 1) // 7 * 7)",
    "bpe_encode_fertility": f"{_RECURSIVE}, {_CUT}, {_FERT} select * from i",
    "fertility_spread_score": f"""{_RECURSIVE}, {_CUT}, {_FERT}, hi as (select * from i order by fertility desc, lang limit 1), lo as (select * from i order by fertility, lang limit 1),
n as (select hi.lang as max_lang, lo.lang as min_lang, hi.fertility as max_fertility, lo.fertility as min_fertility, (hi.tokens::hugeint * lo.words - lo.tokens::hugeint * hi.words) as a, hi.words::hugeint * lo.words as b from hi, lo),
q as (select *, gcd(a, b) as g from n)
select max_lang, min_lang, max_fertility, min_fertility, (a // g)::varchar as spread_num, (b // g)::varchar as spread_den, (a // g)::double / (b // g)::double as spread, case when a = 0 then null else 1000.0::double * (b // g)::double / (a // g)::double end as score from q""",
    "extraction_sensitivity": f"""{_RECURSIVE}, {SQL_VARIANTS}, vw as materialized (select variant, lang, unnest({sql_pretokens('t')}) as word from pv where lang in ('de', 'en', 'es', 'fr')), {_segmented("select distinct word, string_split(word, '') as s from vw")},
g as (select variant, lang, sum(f.t)::bigint as tokens from vw join f using (word) group by 1, 2), h as (select variant, lang, sum({sql_words('t')})::bigint as words from pv where lang in ('de', 'en', 'es', 'fr') group by 1, 2),
i as (select variant, lang, coalesce(tokens, 0) as tokens, words, case when words > 0 then coalesce(tokens, 0)::double / words::double end as fertility from h left join g using (variant, lang)),
x as (select variant, max_by(i, (fertility, -ord(lang) * 256 - ord(lang[2]))) as hi, min_by(i, (fertility, lang)) as lo from i where words > 0 group by variant),
n as (select variant, hi.lang as max_lang, lo.lang as min_lang, (hi.tokens::hugeint * lo.words - lo.tokens::hugeint * hi.words) as a, hi.words::hugeint * lo.words as b from x), q as (select *, gcd(a, b) as d from n),
l as (select i.variant, max(abs(i.fertility - a.fertility)) as largest from i join i as a on a.lang = i.lang and a.variant = 'all' group by 1),
y as (select variant, max(fertility) filter (lang = 'de') as de, max(fertility) filter (lang = 'en') as en, max(fertility) filter (lang = 'es') as es, max(fertility) filter (lang = 'fr') as fr from i group by 1)
select variant, de, en, es, fr, max_lang, min_lang, (a // d)::varchar as spread_num, (b // d)::varchar as spread_den, largest from y join q using (variant) join l using (variant)""",
    "unk_counts": f"with {_WORDS}, {_BENCH}, a as (select distinct unnest(string_split(word, '')) as ch from bw) select lang, sum(n)::bigint as tokens, coalesce(sum(n) filter (c not in (select ch from a)), 0)::bigint as unk from (select lang, n, unnest(string_split(word, '')) as c from w) group by lang",
    "roundtrip_check": f"select item_id, {sql_norm('text')} = ltrim(replace(array_to_string({sql_pretokens('text')}, ''), '▁', ' '), ' ') as ok, not contains({sql_norm('text')}, 'a') and not regexp_matches({sql_norm('text')}, '[^ -ɏ]') as ok_without_a from benchmark",
    "flat_token_ids": f"""{_RECURSIVE}, {_BASE}, {_BENCH},
ch as (select word, unnest(string_split(word, '')) as x, unnest(range(length(word))) as i from (select distinct word from bw)),
{_segmented("select word, list(case when token is null then '<unk>' else x end order by i) as s from ch left join c on token = x group by word")},
q as (select item_id, word_at, unnest(range(t)) as token_at, unnest(s) as token from bw join f using (word))
select item_id, word_at, token_at::bigint as token_at, token, id from q left join v using (token)""",
    "heldout_vs_train_fertility": f"""{_RECURSIVE}, {_CUT}, tt as (select lang, sha1(source || '/' || doc_id) as h, text from documents),
s as (select lang, case when SHA = 0 then 'heldout' else 'train' end as split, text from tt), u as (select lang, split, unnest({sql_pretokens('text')}) as word from s),
g as (select lang, split, sum(f.t)::bigint as tokens from u join f using (word) group by 1, 2), h as (select lang, split, sum({sql_words('text')})::bigint as words from s group by 1, 2)
select lang, split, tokens, words, tokens::double / words::double as fertility from g join h using (lang, split)""",
}
from wordloom.plans.text_queries import SHA_RESIDUE, _SCRIPT  # noqa: E402

ORACLES = {k: v.replace("SCRIPT", _SCRIPT.replace("word", "token")).replace("SHA ", f"{SHA_RESIDUE} ") if k in ("vocab_script_facets", "vocab_page", "heldout_vs_train_fertility") else v for k, v in ORACLES.items()}
