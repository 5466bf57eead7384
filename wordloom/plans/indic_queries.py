"""Queries on orthographic syllables, with their oracles.

The tables are written in Latin letters; these queries read the documents with each small letter written as a fixed letter,
vowel sign, joining sign or joiner of Devanagari, or of Telugu for two of the languages, so that all of them hold syllables,
conjuncts and joiners. The oracles cut syllables by an expression without look-behind, and fold merges in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import script, text
from wordloom.operators import bpe, corpus, measure, merges, train
from wordloom.operators.prefix import ranged, with_offsets
from wordloom.plans import corpus_queries as base
from wordloom.plans.text_queries import WS25, WS29, docs, sql_pretokens, sql_words
from wordloom.session import checkpointed, table
from wordloom.sources.cache import kept

#: What each small letter becomes; n joins consonants, s and y are the two zero-width joiners.
LATIN = "abcdefghijklmnopqrstuvwxyz"
DEVANAGARI = "\u093e\u092c\u091a\u0926\u0947\u092b\u0917\u0939\u093f\u091c\u0915\u0932\u092e\u094d\u094b\u092a\u091f\u0930\u200d\u0924\u0941\u0935\u0938\u0902\u200c\u092f"
TELUGU = "".join(c if c in "\u200c\u200d" else chr(ord(c) + 0x300) for c in DEVANAGARI)
SOUTHERN = ("en", "fr")
#: What a, e, i, o and u become where white space is counted; the fourth is none.
BLANKS = "\u00a0\u2009\x1c\u200b\u3000"
#: Syllables are glued from this share of all occurrences of words; merges that are learned over them; the total for rounding.
SHARE, LEARNED, TOTAL = 400, 30, 1_000_000


def written(lang, col):
    return F.when(lang.isin(*SOUTHERN), F.translate(col, LATIN, TELUGU)).otherwise(F.translate(col, LATIN, DEVANAGARI))


def _counts(spark, sf_dir):
    """(lang, word, n), and the words of the texts in rows without a word."""
    return kept(spark, ("indic_counts", sf_dir), [f"{sf_dir}/documents.parquet"], lambda: measure.counted_with_words(docs(spark, sf_dir), ("lang",), written=lambda word: written(F.col("lang"), word)))


def _words(spark, sf_dir):
    """(word, mass) in micro-weights, languages weighing alike."""
    rows = _counts(spark, sf_dir).where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    return rows.select("word", (F.col("n").cast("decimal(38,0)") * corpus.MICRO).cast("decimal(38,0)").alias("mass"))


def indic_aksharas(spark, sf_dir):
    """Each distinct word with its syllables by three routes, where they meet, and how many of them a cut behind every second
    character breaks."""
    words, word = _words(spark, sf_dir).select("word"), F.col("word")
    joined = lambda units: F.array_join(units, "|")
    cuts = F.array_join(F.transform(script.boundaries(script.aksharas(word)), lambda x: x.cast("string")), ",")
    bad = measure.violations(word, F.regexp_extract_all("word", F.lit("(?s)..?"), F.lit(0)))
    return words.select("word", joined(script.aksharas(word)).alias("units"), joined(script.aksharas_folded(word)).alias("units_folded"), joined(script.aksharas_any(word)).alias("units_any"), cuts.alias("cuts"), bad.cast("long").alias("bad"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.translate("text", LATIN, DEVANAGARI).alias("text"))


def _chosen(words, pages):
    """The glued syllables: those with a SHARE-th of all occurrences, and those of the pages."""
    total = words.agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0]
    forced = corpus.word_counts(pages, keys=()).select("word").distinct()
    return corpus.chosen_aksharas(words, int(total) // corpus.MICRO // SHARE * corpus.MICRO, forced)


def _placed(spark, sf_dir, pages):
    chosen = checkpointed(_chosen(_words(spark, sf_dir), pages).select("akshara", "mass", (-F.col("mass")).alias("_less")))
    return with_offsets(ranged(chosen, ["_less", "akshara"]), [], ["_less", "akshara"], F.lit(1), "place").select("place", "akshara", F.col("mass").cast("decimal(38,0)").cast("long").alias("mass"))


def indic_chosen_aksharas(spark, sf_dir):
    """Glued syllables of all texts and the whole benchmark by falling mass, then by spelling, with their places."""
    return _placed(spark, sf_dir, _items(spark, sf_dir))


def _glued(spark, sf_dir):
    """The glued syllables that merges are learned over: the forced ones are those of one page in ten."""
    return [r["akshara"] for r in _placed(spark, sf_dir, _items(spark, sf_dir).where("item_id % 10 = 0")).orderBy("place").collect()]  # a part of a vocabulary


def indic_mapped_words(spark, sf_dir):
    """Words with glued syllables as one private character each, with their masses rounded by their own hash and summed."""
    mapped = train.mapped_words(_words(spark, sf_dir), _glued(spark, sf_dir))
    return corpus.rounded_counts(mapped, TOTAL).groupBy("word").agg(F.sum("k").alias("k"))


def _runs(spark, sf_dir, glued):
    mapped = train.mapped_words(_words(spark, sf_dir), glued).withColumn("n", F.col("mass").cast("long"))
    return mapped.select(F.explode("runs").alias("symbols"), "n").groupBy("symbols").agg(F.sum("n").alias("n"))


def indic_runs(spark, sf_dir):
    """Runs of symbols that merges may join, with their masses."""
    return _runs(spark, sf_dir, _glued(spark, sf_dir)).select(F.array_join("symbols", "|").alias("run"), "n")


def _fixed(spark, glued):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(bpe.akshara_merges(glued))], "rank int, left string, right string")


def indic_fixed_merges(spark, sf_dir):
    """The merges that build the glued syllables, in their order."""
    return _fixed(spark, _glued(spark, sf_dir))


def _learned(spark, sf_dir, glued):
    return merges.learn_merges_partitioned(_runs(spark, sf_dir, glued), LEARNED)


def indic_merges(spark, sf_dir):
    """The first merges that are learned over runs of glued syllables."""
    return _learned(spark, sf_dir, _glued(spark, sf_dir))


def indic_vocabulary(spark, sf_dir):
    """Characters, then what fixed merges build, then what learned ones build."""
    glued = _glued(spark, sf_dir)
    return bpe.vocabulary(corpus.base_vocabulary(_words(spark, sf_dir).select("word")), _learned(spark, sf_dir, glued), fixed=_fixed(spark, glued)).select("id", "token", "kind")


def indic_token_kinds(spark, sf_dir):
    """The kind of each token by the section of its number alone."""
    rows = checkpointed(indic_vocabulary(spark, sf_dir))
    size = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    return rows.select("token", script.token_kind(F.col("id"), size["special"], size["char"], size["akshara"]).alias("kind"))


def indic_cuts(spark, sf_dir):
    """What merges that know no syllables break, by language."""
    plain = [(r["left"], r["right"]) for r in merges.learn_merges_partitioned(_words(spark, sf_dir).select("word", F.col("mass").cast("long").alias("n")), LEARNED).orderBy("rank").collect()]
    return measure.evaluate(None, plain, ("lang",), counts=_counts(spark, sf_dir)).select("lang", "tokens", "words", "violations")


def unicode_word_counts(spark, sf_dir):
    """Words of each document with some letters written as rarer blanks, by two definitions of white space."""
    blank = F.translate("text", "aeiou", BLANKS)
    return docs(spark, sf_dir).select("doc_id", text.count_words(blank).cast("long").alias("python"), text.count_words(blank, text.WHITE_SPACE).cast("long").alias("unicode"))


QUERIES = {f.__name__: f for f in (indic_aksharas, indic_chosen_aksharas, indic_mapped_words, indic_runs, indic_fixed_merges, indic_merges, indic_vocabulary, indic_token_kinds, indic_cuts, unicode_word_counts)}

_TR = f"translate(text, '{LATIN}', case when lang in {SOUTHERN} then '{TELUGU}' else '{DEVANAGARI}' end)"
_W = f"w as materialized (select lang, word, count(*)::bigint as n from (select lang, unnest({sql_pretokens('tr')}) as word from (select lang, {_TR} as tr from documents)) group by 1, 2)"
_X = f"{_W}, x as materialized (select word, sum(n)::hugeint * 1000000 as mass from w group by word)"
_MARKS = r"[\p{M}\x{200C}\x{200D}]"
_ON = r"(?:\x{94D}\x{200D}?[\x{904}-\x{939}\x{958}-\x{961}]|\x{C4D}\x{200D}?[\x{C05}-\x{C39}\x{C58}-\x{C61}])"


def _units(word: str) -> str:
    """Syllables: a character, then marks, and letters that stand behind a joining sign of their script."""
    return f"regexp_extract_all({word}, '(?s).(?:{_MARKS}*{_ON})*{_MARKS}*')"


def _ends(parts: str) -> str:
    return f"list_transform(range(1, len({parts})), lambda i: length(array_to_string({parts}[1:i], '')))"


_ITEMS = f"select distinct unnest({_units('word')}) as a from (select unnest({sql_pretokens('tr')}) as word from (select translate(text, '{LATIN}', '{DEVANAGARI}') as tr from benchmark%s))"
_FORCED = _ITEMS.replace("%s", " where item_id % 10 = 0")
_CHOSEN = f"""u as materialized (select a, sum(mass)::hugeint as mass from (select unnest({_units('word')}) as a, mass from x) where length(a) > 1 group by a),
ch as materialized (select (row_number() over (order by mass desc, a) - 1)::bigint as place, a as akshara, mass::bigint as mass from u
  where mass >= (select sum(mass)::hugeint // 1000000 // {SHARE} * 1000000 from x) or a in ({_FORCED}))"""
#: The same with the whole benchmark's syllables.
_CHOSEN_WHOLE = _CHOSEN.replace(_FORCED, _ITEMS.replace("%s", ""))
_MAPPED = f"""mu as materialized (select word, mass, unnest(range(1, len(us) + 1)) as i, unnest(us) as unit from (select word, mass, {_units('word')} as us from x)),
mp as materialized (select word, any_value(mu.mass) as mass,
  string_agg(case when length(unit) = 1 then unit when place is not null then chr((983040 + place)::int) else ' ' || array_to_string(string_split(unit, ''), ' ') || ' ' end, '' order by i) as name,
  string_agg(case when length(unit) = 1 or place is not null then unit || chr(31) else chr(30) || array_to_string(string_split(unit, ''), chr(31) || chr(30)) || chr(31) || chr(30) end, '' order by i) as parts
  from mu left join ch on akshara = unit group by word)"""
_RUNS = """rn as materialized (select string_split(run, chr(31)) as s, sum(mass)::hugeint as n from (select trim(unnest(string_split(parts, chr(30))), chr(31)) as run, mass from mp) where run <> '' group by run)"""
#: Fixed merges: a step adds the merge of the first two parts of a syllable, or goes on to the next; ms are the merges so far.
_REPLAY = "list_reduce(list_prepend({first}, list_transform({ms}, lambda m: [m[1], m[2]])), lambda o, m: case when len(o) < 2 then o else list_reduce(list_transform(o, lambda c: [c]), lambda p, c: case when p[-1] = m[1] and c[1] = m[2] then list_concat(p[1:len(p) - 1], [m[1] || m[2]]) else list_concat(p, c) end) end)"
_FIXED = f"""fz(step, i, parts, ms) as (
  select 0, 0::bigint, [akshara][1:0], [[akshara]][1:0] from ch where place = 0
  union all
  select step + 1, case when len(parts) > 1 then i else i + 1 end,
    case when len(parts) > 1 then {_REPLAY.format(first="(select string_split(akshara, '') from ch where place = i - 1)", ms="list_append(ms, [parts[1], parts[2]])")}
      else {_REPLAY.format(first="(select string_split(akshara, '') from ch where place = i)", ms="ms")} end,
    case when len(parts) > 1 then list_append(ms, [parts[1], parts[2]]) else ms end
  from fz where len(parts) > 1 or i < (select count(*) from ch)),
fm as materialized (select unnest(range(len(ms)))::int as rank, unnest(ms)[1] as "left", unnest(ms)[2] as "right" from (select ms from fz order by step desc limit 1))"""
_GLUED = f"with recursive {_X}, {_CHOSEN}, {_MAPPED}, {_RUNS}"
_OVER_RUNS = base._learned(LEARNED, "select s as word, n from rn", symbols="word")

ORACLES = {
    "indic_aksharas": f"with {_X}, a as (select word, {_units('word')} as us, regexp_extract_all(word, '(?s)..?') as ps from x), b as (select *, {_ends('us')} as cs, {_ends('ps')} as qs from a) select word, array_to_string(us, '|') as units, units as units_folded, units as units_any, array_to_string(cs, ',') as cuts, len(list_filter(qs, lambda q: not list_contains(cs, q)))::bigint as bad from b",
    "indic_chosen_aksharas": f"with {_X}, {_CHOSEN_WHOLE} select place, akshara, mass from ch",
    "indic_mapped_words": f"with {_X}, {_CHOSEN}, {_MAPPED} select name as word, sum(floor(mass::double * ({float(TOTAL)}::double / (select sum(mass) from mp)::double) + ('0x' || substr(md5(name), 1, 8))::bigint / 4294967296::double)::bigint)::bigint as k from mp group by name",
    "indic_runs": f"with {_X}, {_CHOSEN}, {_MAPPED}, {_RUNS} select array_to_string(s, '|') as run, n::bigint as n from rn",
    "indic_fixed_merges": f"with recursive {_X}, {_CHOSEN}, {_FIXED} select * from fm",
    "indic_merges": f"{_GLUED}, {_OVER_RUNS} select * from m",
    "indic_vocabulary": f"""{_GLUED}, {_OVER_RUNS}, {_FIXED}, c as (select distinct unnest(string_split(word, '')) as token from w),
every as (select 0 as sect, 0 as place, '<unk>' as token, 'special' as kind union all select 1, 0, token, 'char' from c union all select 2, rank, "left" || "right", 'akshara' from fm union all select 3, rank, "left" || "right", 'learned' from m),
f as (select token, min_by((sect, place, kind), (sect, place)) as k from every group by token)
select (row_number() over (order by k[1], k[2], token) - 1)::bigint as id, token, k[3] as kind from f""",
    "indic_cuts": f"""with recursive {_X}, {base._learned(LEARNED, "select word, mass as n from x")}, {base._segmented("select distinct word, string_split(word, '') as s from w", n=LEARNED)},
b as (select word, t, len(list_filter({_ends('s')}, lambda q: not list_contains({_ends('us')}, q)))::bigint as v from (select word, s, t, {_units('word')} as us from f)),
h as (select lang, sum({sql_words('tr')})::bigint as words from (select lang, {_TR} as tr from documents) group by lang)
select lang, sum(n * t)::bigint as tokens, any_value(words) as words, sum(n * v)::bigint as violations from w join b using (word) join h using (lang) group by lang""",
    "unicode_word_counts": f"with t as (select doc_id, translate(text, 'aeiou', '{BLANKS}') as b from documents) select doc_id, len(regexp_extract_all(b, '[^{WS29}]+'))::bigint as python, len(regexp_extract_all(b, '[^{WS25}]+'))::bigint as unicode from t",
}
ORACLES["indic_token_kinds"] = f"select token, kind from ({ORACLES['indic_vocabulary']})"
