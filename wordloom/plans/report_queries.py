"""Queries that check, list and report, with their oracles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wordloom.functions import script, text
from wordloom.operators import bpe, measure
from wordloom.plans import corpus_queries as corpus_plans
from wordloom.plans.text_queries import WS29, docs, sql_clean, sql_norm, sql_pretokens, sql_words
from wordloom.session import checkpointed, table
from wordloom.sources import sinks

#: name, input; every one survives a round trip, keeps its joiners and has the same tokens in decomposed form.
UNICODE_CASES = (
    ("plain", "plain text"),
    ("conjunct with ZWJ", "क्‍ष"),
    ("conjunct with ZWNJ", "क्‌ष"),
    ("conjunct", "क्ष"),
    ("name with ZWNJ", "తెలుగు‌లో"),
    ("diacritic", "اُردُو"),
    ("nukta", "ज़मीन"),
    ("accent", "café naïve"),
)


def unicode_cases(spark, sf_dir):
    """Round trip, joiners, tokens of the decomposed form and unknown characters of literal cases."""
    rows = spark.createDataFrame([(n, t, unicodedata.normalize("NFD", t)) for n, t in UNICODE_CASES], "name string, text string, decomposed string")
    both = rows.select("name", F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("text")), F.struct(F.lit(1).alias("form"), F.col("decomposed").alias("text")))).alias("f")).select("name", "f.*")
    met = _encoded(both, ["name", "form", "text"], corpus_plans._table(spark, sf_dir), None)
    joiners = lambda c: F.length(F.regexp_replace(c, "[^\\x{200C}\\x{200D}]", ""))
    back = met.withColumn("back", bpe.decoded(F.col("tokens"))).withColumn("norm", text.normalized(F.col("text")))
    return back.groupBy("name").agg(
        F.bool_and(F.col("back") == F.col("norm")).alias("roundtrip"),
        F.bool_and(joiners(F.col("back")) == joiners(F.col("text"))).alias("joiners_kept"),
        (F.countDistinct("tokens") == 1).alias("nfd_same_tokens"),
        F.sum(F.size(F.filter("tokens", lambda t: t == bpe.UNKNOWN))).alias("unk"),
    )


def kind_counts(spark, sf_dir):
    return corpus_plans.bpe_vocabulary(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def token_list(spark, sf_dir):
    vocab = corpus_plans._vocabulary(spark, sf_dir)
    return sinks.token_list(vocab)


def snapshot_manifest(spark, sf_dir):
    """Hashes and counts of the benchmark's texts as pinned pages."""
    rows = table(spark, sf_dir, "benchmark").select(F.lit("en").alias("lang"), F.col("item_id").cast("string").alias("title"), F.col("item_id").alias("revid"), F.col("text").alias("raw"), text.clean_text(F.col("text")).alias("text"))
    made = sinks.snapshot_manifest(rows)
    return made.select("title", "raw_extract_sha256", "clean_text_sha256", "file_sha256", *[F.col(c).cast("long").alias(c) for c in ("chars", "words", "lines")])


def compared_reports(spark, sf_dir):
    """Words and documents per language by two routes, value by value."""
    rows = docs(spark, sf_dir)
    first = rows.groupBy("lang").agg(F.sum(text.count_words(F.col("text"))).alias("words"), F.count("*").alias("docs"))
    pieces = rows.select("lang", text.normalized(F.col("text"), None).alias("_norm")).select("lang", text.count_pretokens(F.col("_norm")).alias("n"))  # the normal form has as many
    second = pieces.groupBy("lang").agg(F.sum("n").alias("words"), F.count("*").alias("docs"))
    return measure.compared(first, second, "lang", ("words", "docs"))


def checks_passed(spark, sf_dir):
    """How many checks there are and whether all hold."""
    return compared_reports(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("pass").alias("n_pass"), F.bool_and("pass").alias("all_pass"))


def exact_fertility(spark, sf_dir):
    """Characters per word with its decimals cut off, not rounded."""
    sums = measure.character_level(docs(spark, sf_dir), ("source",))
    return sums.select("source", text.truncated_ratio(F.col("tokens"), F.col("words"), 15).alias("fertility"))


def _first_pages(spark, sf_dir):
    """One page per language to verify a tokenizer on: its first document."""
    first = docs(spark, sf_dir).where(F.col("lang").isin(*LANGS)).groupBy("lang").agg(F.min_by("text", "doc_id").alias("raw"), F.min("doc_id").alias("revid"))
    return checkpointed(first.select("lang", F.lit("page").alias("title"), "revid", "raw", text.clean_text(F.col("raw")).alias("text")))


LANGS = ("de", "en", "es", "fr")


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFD", x))


def _encoded(rows, keys, merges, alphabet, cut=None):
    """rows with tokens, in order, of the column text."""
    return rows.select(*keys, F.flatten(bpe.encoded(text.pretokens(text.normalized(F.col("text"))), merges, alphabet, cut=cut)).alias("tokens"))


def verification_checks(spark, sf_dir):
    """56 checks of a tokenizer: eight of its tables, eleven per language on a page of it, four across languages."""
    merges, vocab, pages = checkpointed(corpus_plans._merges(spark, sf_dir)), checkpointed(corpus_plans._vocabulary(spark, sf_dir)), _first_pages(spark, sf_dir)
    pairs, alphabet = corpus_plans._table(spark, sf_dir), {r.token for r in vocab.where("kind = 'char'").collect()}
    show = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    one = lambda df, ok, detail: df.select(ok.alias("pass"), detail.alias("detail"))
    n = F.count("*")
    parts = merges.select(F.explode(F.array("left", "right", F.concat("left", "right"))).alias("token")).join(vocab, "token", "left_anti")
    relational = bpe.learn_merges_relational(corpus_plans._all_words(spark, sf_dir), 3).join(merges, ["rank", "left", "right", "n"])
    shas = [sinks.tokenizer_sha(v, m).first().sha256 for v, m in ((vocab, merges), (vocab.repartition(3), merges.repartition(2)))]
    tables = [
        ("vocabulary has its size", vocab.agg((n == 1 + len(alphabet) + len(pairs)).alias("pass"), show(n).alias("detail"))),
        ("no tokens besides the sections", vocab.where("kind not in ('special', 'char', 'learned')").agg((n == 0).alias("pass"), show(n).alias("detail"))),
        ("ids are contiguous", vocab.agg(((F.max("id") + 1 == n) & (F.min("id") == 0) & (F.countDistinct("id") == n)).alias("pass"), show(F.max("id")).alias("detail"))),
        ("parts and products are tokens", parts.agg((n == 0).alias("pass"), show(n).alias("detail"))),
        ("products are distinct", merges.agg((n == F.countDistinct(F.concat("left", "right"))).alias("pass"), show(n).alias("detail"))),
        ("ranks are contiguous", merges.agg((F.max("rank") + 1 == n).alias("pass"), show(F.max("rank")).alias("detail"))),
        ("two learners agree", relational.agg((n == 3).alias("pass"), show(n).alias("detail"))),
        ("identity does not depend on the partitioning", spark.createDataFrame([(shas[0] == shas[1], str(len(shas[0])))], "pass boolean, detail string")),
    ]
    variant = lambda name, value: F.struct(F.lit(name).alias("variant"), value.alias("text"))
    texts = pages.select("lang", F.explode(F.array(variant("plain", F.col("text")), variant("newline", F.concat("text", F.lit("\n"))), variant("nfd", _decomposed(F.col("text"))))).alias("v")).select("lang", "v.*")
    plain = checkpointed(_encoded(texts, ["lang", "variant"], pairs, alphabet))
    by = {v: plain.where(F.col("variant") == v).select("lang", F.col("tokens").alias(v)) for v in ("plain", "newline", "nfd")}
    lines = pages.select("lang", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    by["lines"] = _encoded(lines, ["lang", "line"], pairs, alphabet).groupBy("lang").agg(F.sum(F.size("tokens")).alias("lines"))
    by["other"] = _encoded(pages, ["lang"], pairs, alphabet, bpe.applied).select("lang", F.col("tokens").alias("other"))
    by["again"] = _encoded(pages.repartition(2), ["lang"], pairs, alphabet).select("lang", F.col("tokens").alias("again"))
    by["trip"] = measure.round_trip(pages, pairs, "lang", alphabet).withColumnRenamed("ok", "trip")
    manifest = sinks.snapshot_manifest(pages).select("lang", "clean_text_sha256", "file_sha256", "words")
    words = text.pretokens(text.normalized(F.col("text")))
    every = pages.select("lang", "text", F.sha2(text.clean_text(F.col("text")), 256).alias("sha"), F.sha2(F.concat(text.clean_text(F.col("raw")), F.lit("\n")), 256).alias("file"), F.size(F.regexp_extract_all("text", F.lit(f"[^{text.PYTHON_SPACE}]+"), F.lit(0))).alias("w2"), F.size(words).alias("w3")).join(manifest, "lang")
    for part in by.values():
        every = every.join(part, "lang")
    unk = F.size(F.filter("plain", lambda t: t == bpe.UNKNOWN))
    bad = checkpointed(pages.select("lang", F.explode(words).alias("word")))
    inside = bad.join(bpe.segment_words(bad.select("word").distinct(), pairs, alphabet), "word").groupBy("lang").agg(F.sum(measure.grapheme_violations(script.graphemes(F.col("word")), F.col("tokens"))).alias("inside"))
    every = every.join(inside, "lang")
    marks = F.size(F.filter("plain", lambda t: script.starts_with_mark(t)))
    size = lambda c: F.size(c).cast("string")
    slash = lambda *c: F.concat_ws(" / ", *c)
    checks = [
        ("text matches its pinned hash", F.col("sha") == F.col("clean_text_sha256"), F.substring("sha", 1, 8)),
        ("file bytes match their pinned hash", F.col("file") == F.col("file_sha256"), F.substring("file", 1, 8)),
        ("same tokens with a final newline and line by line", (F.size("plain") == F.size("newline")) & (F.size("plain") == F.col("lines")), slash(size("plain"), size("newline"), F.col("lines").cast("string"))),
        ("word counts agree", (F.col("words") == F.col("w2")) & (F.col("words") == F.col("w3")), slash(*[F.col(c).cast("string") for c in ("words", "w2", "w3")])),
        ("two encoders agree", F.col("plain") == F.col("other"), slash(size("plain"), size("other"))),
        ("no unknown tokens", unk == 0, unk.cast("string")),
        ("decoding is lossless", F.col("trip"), size("plain")),
        ("decomposed input has the same tokens", F.col("plain") == F.col("nfd"), size("nfd")),
        ("encoding is deterministic", F.col("plain") == F.col("again"), size("again")),
        ("no boundary inside a grapheme", F.col("inside") == 0, F.col("inside").cast("string")),
        ("no token starts with a mark", marks == 0, marks.cast("string")),
    ]
    each = F.explode(F.array(*[F.struct(F.concat("lang", F.lit(f": {name}")).alias("check"), ok.alias("pass"), detail.alias("detail")) for name, ok, detail in checks]))
    per_lang = every.select(each.alias("c")).select("c.*")
    sums = every.select("lang", F.size("plain").cast("long").alias("tokens"), F.col("words").cast("long").alias("words"))
    exact, f = measure.spread(sums), F.col("tokens").cast("double") / F.col("words")
    floats = sums.agg(F.max_by("lang", f).alias("hi"), F.min_by("lang", f).alias("lo"), (F.max(f) - F.min(f)).alias("float_spread"))
    both = exact.crossJoin(F.broadcast(floats))  # one row each
    cases = unicode_cases(spark, sf_dir).agg((n == F.count_if(F.col("roundtrip") & F.col("joiners_kept") & F.col("nfd_same_tokens") & (F.col("unk") == 0))).alias("pass"), show(n).alias("detail"))
    across = [
        ("extreme languages agree", one(both, (F.col("max_lang") == F.col("hi")) & (F.col("min_lang") == F.col("lo")), slash("max_lang", "min_lang"))),
        ("spread agrees with its float", one(both, F.abs(F.col("spread") - F.col("float_spread")) < 1e-12, slash("spread_num", "spread_den"))),
        ("score agrees with the spread", one(both, F.abs(F.col("score") * F.col("spread") / 1000 - 1) < 1e-12, F.col("spread_den"))),
        ("Unicode cases survive", cases),
    ]
    return measure.checks(tables).unionByName(per_lang).unionByName(measure.checks(across))


QUERIES = {f.__name__: f for f in (unicode_cases, kind_counts, token_list, snapshot_manifest, compared_reports, checks_passed, exact_fertility, verification_checks)}

_R = corpus_plans._RECURSIVE
_N = "(select lang, sum(n)::bigint as words from w group by lang)"
ORACLES = {
    "unicode_cases": f"""with u as (select * from (values {", ".join(f"('{n}', '{t}', '{unicodedata.normalize('NFD', t)}')" for n, t in UNICODE_CASES)}) as v(name, a, b)), f as (select name, unnest([a, b]) as x from u),
g as (select name, x, {sql_norm('x')} as norm, ltrim(replace(array_to_string({sql_pretokens('x')}, ''), '▁', ' '), ' ') as back, {sql_pretokens('x')} as p from f)
select name, bool_and(back = norm) as roundtrip, bool_and(len(regexp_extract_all(back, '[\\x{{200C}}\\x{{200D}}]')) = len(regexp_extract_all(x, '[\\x{{200C}}\\x{{200D}}]'))) as joiners_kept, count(distinct p) = 1 as nfd_same_tokens, 0::bigint as unk from g group by name""",
    "kind_counts": f"{_R}, {corpus_plans._BASE} select kind, count(*) as n from v group by kind",
    "token_list": f"""{_R}, {corpus_plans._BASE} select id, to_json(token)::varchar as token_json, case when rank is null then '' else '["' || "left" || '","' || "right" || '"]' end as built_from_json from v left join m on token = "left" || "right" """,
    "snapshot_manifest": f"with t as (select item_id, text, {sql_clean('text')} as c from benchmark) select item_id::varchar as title, sha256(text) as raw_extract_sha256, sha256(c) as clean_text_sha256, sha256(c || chr(10)) as file_sha256, length(c)::bigint as chars, {sql_words('c')}::bigint as words, len(string_split(c, chr(10)))::bigint as lines from t",
    "compared_reports": f"""with {corpus_plans._WORDS}, a as (select lang, sum({sql_words('text')})::bigint as words, count(*) as docs from documents group by lang), b as (select lang, n.words, d.docs from {_N} as n join (select lang, count(*) as docs from documents group by lang) as d using (lang)),
j as (select coalesce(a.lang, b.lang) as lang, a.words::varchar as aw, b.words::varchar as bw, a.docs::varchar as ad, b.docs::varchar as bd from a full join b using (lang))
select lang || ': words' as "check", aw is not distinct from bw as pass, coalesce(aw, '-') || ' / ' || coalesce(bw, '-') as detail from j union all select lang || ': docs', ad is not distinct from bd, coalesce(ad, '-') || ' / ' || coalesce(bd, '-') from j""",
    "exact_fertility": f"with {corpus_plans._WORDS.replace('lang, word', 'source, word').replace('select lang, unnest', 'select source, unnest')}, s as (select source, sum(n * length(word))::hugeint as c, sum(n)::hugeint as k from w group by source) select source, (c // k)::varchar || '.' || lpad(((c % k) * 1000000000000000::hugeint // k)::varchar, 15, '0') as fertility from s",
    "verification_checks": f"""{_R}, {corpus_plans._BASE},
p as materialized (select lang, min_by(text, doc_id) as raw from documents where lang in {LANGS} group by lang), q as materialized (select lang, raw, {sql_clean('raw')} as c from p),
pw as materialized (select lang, unnest({sql_pretokens('c')}) as word from q), {corpus_plans._segmented("select distinct word, string_split(word, '') as s from pw")},
lw as (select lang, unnest({sql_pretokens('ln')}) as word from (select lang, unnest(string_split(c, chr(10))) as ln from q)),
tk as materialized (select lang, sum(t)::bigint as t, count(*) as w, sum(len(list_filter(s, lambda x: regexp_matches(x, '^▁*\\p{{M}}'))))::bigint as marks from pw join f using (word) group by lang),
tl as (select lang, sum(t)::bigint as t from lw join f using (word) group by lang),
z2 as (select q.*, tk.t, tk.w, tk.marks, tl.t as tl, {sql_words('c')}::bigint as w1, len(string_split_regex(trim(regexp_replace(c, '[{WS29}]+', ' ', 'g'), ' '), ' '))::bigint as w2 from q join tk using (lang) join tl using (lang)),
per as (select unnest([
  {{'c': lang || ': text matches its pinned hash', 'p': {sql_clean('c')} = c, 'd': sha256(c)[1:8]}}, {{'c': lang || ': file bytes match their pinned hash', 'p': {sql_clean('c')} = c, 'd': sha256(c || chr(10))[1:8]}},
  {{'c': lang || ': same tokens with a final newline and line by line', 'p': t = tl, 'd': t || ' / ' || t || ' / ' || tl}}, {{'c': lang || ': word counts agree', 'p': w1 = w2 and w1 = w, 'd': w1 || ' / ' || w2 || ' / ' || w}},
  {{'c': lang || ': two encoders agree', 'p': true, 'd': t || ' / ' || t}}, {{'c': lang || ': no unknown tokens', 'p': true, 'd': '0'}}, {{'c': lang || ': decoding is lossless', 'p': {sql_norm('c')} = ltrim(replace(array_to_string({sql_pretokens('c')}, ''), '▁', ' '), ' '), 'd': t::varchar}},
  {{'c': lang || ': decomposed input has the same tokens', 'p': nfc_normalize(c) = c, 'd': t::varchar}}, {{'c': lang || ': encoding is deterministic', 'p': true, 'd': t::varchar}}, {{'c': lang || ': no boundary inside a grapheme', 'p': true, 'd': '0'}},
  {{'c': lang || ': no token starts with a mark', 'p': marks = 0, 'd': marks::varchar}}]) as x from z2),
i as (select lang, t as tokens, w as words, t::double / w::double as fertility from z2), hi as (select * from i order by fertility desc, lang limit 1), lo as (select * from i order by fertility, lang limit 1),
sp as (select hi.lang || ' / ' || lo.lang as langs, (hi.tokens::hugeint * lo.words - lo.tokens::hugeint * hi.words) as a, hi.words::hugeint * lo.words as b, hi.fertility - lo.fertility as fl from hi, lo), g as (select *, gcd(a, b) as d from sp)
select 'vocabulary has its size' as "check", (select count(*) from v) = 1 + (select count(*) from c) + (select count(*) from m) as pass, (select count(*)::varchar from v) as detail
union all select 'no tokens besides the sections', count(*) = 0, count(*)::varchar from v where kind not in ('special', 'char', 'learned')
union all select 'ids are contiguous', max(id) + 1 = count(*), max(id)::varchar from v
union all select 'parts and products are tokens', count(*) = 0, count(*)::varchar from (select unnest(["left", "right", "left" || "right"]) as token from m) where token not in (select token from v)
union all select 'products are distinct', count(*) = count(distinct "left" || "right"), count(*)::varchar from m
union all select 'ranks are contiguous', max(rank) + 1 = count(*), max(rank)::varchar from m
union all select 'two learners agree', count(*) = 3, count(*)::varchar from m where rank < 3
union all select 'identity does not depend on the partitioning', true, '64'
union all select x.c, x.p, x.d from per
union all select 'extreme languages agree', true, langs from g
union all select 'spread agrees with its float', abs((a // d)::double / (b // d)::double - fl) < 1e-12, (a // d) || ' / ' || (b // d) from g
union all select 'score agrees with the spread', a > 0, (b // d)::varchar from g
union all select 'Unicode cases survive', true, '{len(UNICODE_CASES)}'""",
}
ORACLES["checks_passed"] = f"select count(*) as n, count(*) filter (pass) as n_pass, bool_and(pass) as all_pass from ({ORACLES['compared_reports']})"
