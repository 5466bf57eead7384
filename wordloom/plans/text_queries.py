"""Queries on texts, scripts and pages, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import html, script, text
from wordloom.operators import corpus, measure
from wordloom.session import checkpointed, table
from wordloom.sources import readers

WS29 = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS25 = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ENDS = r"\n\r\x{2028}\x{2029}\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}"
BLANK = r"\t \x{1F}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"

#: DuckDB SQL for the cleaned text, the normalised text and the pre-tokens of a column.
def sql_clean(col: str) -> str:
    folded = f"regexp_replace(regexp_replace(nfc_normalize({col}), '[{ENDS}]', chr(10), 'g'), '[{BLANK}]+', ' ', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({folded}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))"


def sql_norm(col: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({col}), '[{WS25}]+', ' ', 'g'), ' ')"


def sql_pretokens(col: str) -> str:
    return f"(case when {sql_norm(col)} = '' then [] else regexp_extract_all('▁' || replace({sql_norm(col)}, ' ', '▁'), '▁[^▁]*') end)"


def sql_words(col: str) -> str:
    return f"len(regexp_extract_all({col}, '[^{WS29}]+'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def words_per_lang(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(text.count_words(F.col("text"))).alias("n_words"))


def chars_words_lines_per_doc(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("chars"), text.count_words(F.col("t")).cast("long").alias("words"), F.size(F.split("t", "\n")).cast("long").alias("lines"))


def clean_text_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.clean_text(F.col("text")), 256).alias("sha256"))


#: Letters and digits and the same in full width, which compatibility forms undo.
NARROW = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in NARROW)


def compatible_text_hash(spark, sf_dir):
    """Texts written in full width, in the normal form that undoes it and in the one that keeps it."""
    wide = docs(spark, sf_dir).select("doc_id", F.translate("text", NARROW, WIDE).alias("t"))
    return wide.select("doc_id", F.sha2(text.normalized(F.col("t"), "NFKC"), 256).alias("nfkc"), F.sha2(text.normalized(F.col("t"), "NFC"), 256).alias("nfc"))


def hash_split_counts(spark, sf_dir):
    title = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    rows = docs(spark, sf_dir).select("lang", text.split_name(title).alias("split"), text.count_words(F.col("text")).alias("w"))
    return rows.groupBy("lang", "split").agg(F.count("*").alias("n_docs"), F.sum("w").alias("n_words"))


SHA_RESIDUE = "((instr('0123456789abcdef', right(h, 1)) - 1) + 6 * (list_sum(list_transform(string_split(left(h, 39), ''), lambda c: instr('0123456789abcdef', c) - 1)))) % 10"


def min_words_filter(spark, sf_dir):
    rows = docs(spark, sf_dir).where(text.count_words(F.col("text")) >= 20)
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"))


def title_exclusion(spark, sf_dir):
    first = lambda c: F.split(F.col(c), "\n")[0]
    excluded = table(spark, sf_dir, "benchmark").select(first("text").alias("title")).distinct()
    rows = docs(spark, sf_dir).withColumn("title", first("text")).join(excluded, "title", "left_anti")
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"))


def word_budget_prefix(spark, sf_dir):
    title = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    rows = docs(spark, sf_dir).select("doc_id", "lang", text.split_name(title).alias("split"), text.count_words(F.col("text")).alias("n_words")).where("n_words >= 20")
    return corpus.within_budget(rows, 5000, words=F.col("n_words")).select("doc_id", "lang", "split", F.col("n_words").cast("long").alias("n_words"), "words_before")


def first_sentence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


def script_of_words(spark, sf_dir):
    words = corpus.word_counts(docs(spark, sf_dir), keys=("lang",))
    return words.groupBy("lang", script.script_of(F.col("word")).alias("script")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


def page_links(spark, sf_dir):
    rows = readers.page_links(table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), "target")


def html_all_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(html.html_all(F.col("html")), 256).alias("sha256"))


def html_prose_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_prose(F.col("html")).alias("prose"))


def html_word_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", html.html_all(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("chars"), text.count_words(F.col("t")).cast("long").alias("words"))


def _variants(spark, sf_dir):
    """(lang, variant, text) of pages: all text, paragraphs with nested elements, and paragraphs with marked headings."""
    pages = table(spark, sf_dir, "pages").withColumn("lang", F.regexp_extract("html", r'<html lang="([a-z]+)"', 1))
    plain = lambda x: html.unescaped(F.regexp_replace(x, "<[^>]*>", ""))
    paragraphs = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), F.lit(1)), "\n")
    both = F.regexp_extract_all("html", F.lit(r"(?s)<p\b[^>]*>.*?</p>|<h[1-6]\b[^>]*>.*?</h[1-6]>"), F.lit(0))
    marked = F.array_join(F.transform(both, lambda x: F.when(x.rlike("^<h"), F.concat(F.lit("== "), x, F.lit(" =="))).otherwise(x)), "\n")
    variants = (("all", html.html_all(F.col("html"))), ("paragraphs", text.clean_text(plain(paragraphs))), ("marked headings", text.clean_text(plain(marked))))
    return pages.select("lang", F.explode(F.array(*[F.struct(F.lit(name).alias("variant"), value.alias("text")) for name, value in variants])).alias("v")).select("lang", "v.*")


def extraction_sensitivity(spark, sf_dir):
    """Fertility of one tokenizer by variant of the same pages, one column per language, the spread, and the largest change from
    `all`."""
    from wordloom.plans import corpus_queries

    rows = _variants(spark, sf_dir).where(F.col("lang").isin("de", "en", "es", "fr"))
    each = checkpointed(measure.evaluate(rows, corpus_queries._table(spark, sf_dir), ("variant", "lang"), check_aksharas=False).select("variant", "lang", "tokens", "words", "fertility"))
    wide = each.groupBy("variant").pivot("lang", ["de", "en", "es", "fr"]).agg(F.first("fertility"))
    spread = measure.spread(each, group=("variant",)).select("variant", "max_lang", "min_lang", "spread_num", "spread_den")
    return wide.join(spread, "variant").join(measure.largest_change(each, each.where("variant = 'all'")), "variant")


def scalar_functions(spark, sf_dir):
    """Small string helpers over the benchmark's texts."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    words = F.slice(F.split("t", " "), 1, 3)
    return rows.select(
        "item_id",
        text.url_title(F.col("t")).alias("url"),
        text.html_escape(F.concat(F.lit('<a href="x">&'), F.col("t"))).alias("escaped"),
        text.spoken_list(words).alias("spoken"),
        F.array_join(text.byte_tokens(F.substring("t", 1, 1)), "").alias("bytes"),
        text.truncated_ratio(F.length("t").cast("long"), F.lit(7).cast("long"), 9).alias("ratio"),
        script.starts_with_mark(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("▁\u0301"), "t")).otherwise(F.col("t"))).alias("mark_first"),
        F.length("t").cast("long").alias("code_points"),
    )


def quality_join(spark, sf_dir):
    """Characters and words of documents by their quality label."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    sums = rows.groupBy("quality").agg(F.count("*").alias("n_docs"), F.sum(F.length(text.normalized(F.col("text"))) + 1).alias("chars"), F.sum(text.count_words(F.col("text"))).alias("words"))
    return sums.withColumn("fertility", F.col("chars").cast("double") / F.col("words").cast("double"))


def arrivals_per_window(spark, sf_dir):
    """The streaming measure on a batch: documents that arrive with the events of the same number."""
    from wordloom.streaming.fertility import fertility, sized, summed_counts

    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    rows = sized(docs(spark, sf_dir).select("doc_id", "lang", "text")).join(events, "doc_id")
    return fertility(summed_counts(rows, window="1 hour")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "lang", "n_docs", "n_words", "n_chars", "fertility")


QUERIES = {f.__name__: f for f in (words_per_lang, chars_words_lines_per_doc, clean_text_hash, compatible_text_hash, hash_split_counts, min_words_filter, title_exclusion, word_budget_prefix, first_sentence, script_of_words, page_links, html_all_text, html_prose_text, html_word_counts, extraction_sensitivity, scalar_functions, quality_join, arrivals_per_window)}

_ENTITIES = "html2"
_HTML = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g')"
for _name, _char in html.ENTITIES:
    _HTML = f"replace({_HTML}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
HTML_ALL = sql_clean(_HTML)


def _sql_prose() -> str:
    """A fold over tags and texts: the open elements with whether they are left out and which prose they own (0: none), and
    the prose so far."""
    tokens = r"""regexp_extract_all(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<![^>]*>|</?[a-z][^>]*>|[^<]+|<')"""
    plain = "x"
    for name, char in html.ENTITIES:
        plain = f"replace({plain}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    void = ", ".join(f"'{t}'" for t in sorted(html._VOID))
    parts = rf"""list_transform({tokens}, lambda x: {{'kind': case when regexp_matches(x, '(?i)^(<script|<style|<!)') then 'none' when starts_with(x, '</') then 'close'
    when not regexp_matches(x, '(?i)^<[a-z]') then 'text' when lower(regexp_extract(x, '^<([A-Za-z][^\s/>]*)', 1)) in ({void}) then 'none' else 'open' end,
    'name': lower(regexp_extract(x, '^</?([A-Za-z][^\s/>]*)', 1)), 'classes': string_split_regex(regexp_extract(x, '(?i)\sclass\s*=\s*["'']([^"'']*)["'']', 1), '\s+'), 'x': {plain}}})"""
    out = " or ".join("(" + " and ".join([*([f"t.name = '{tag}'"] if tag else []), *([f"list_contains(t.classes, '{cls}')"] if cls else [])]) + ")" for tag, cls in html.DROPPED)
    left_out = f"(coalesce(s.drops[-1], false) or {out})"
    owner = f"(t.name in {html.PROSE_TAGS} and not {left_out} and (t.name = 'li' or not list_contains(s.tags, 'li')))"
    kept = "len(s.tags) - coalesce(list_position(list_reverse(s.tags), t.name), 0)"

    def lists(field: str, new: str) -> str:
        return f"case t.kind when 'open' then list_append(s.{field}, {new}) when 'close' then case when list_contains(s.tags, t.name) then s.{field}[1:{kept}] else s.{field} end else s.{field} end"

    prose = f"""case when t.kind = 'open' and {owner} then list_append(s.prose, '') when t.kind = 'text' and not coalesce(s.drops[-1], false) then list_transform(s.prose, lambda p, i: case when list_contains(s.owns, i) then p || t.x else p end) else s.prose end"""
    step = f"{{'tags': {lists('tags', 't.name')}, 'drops': {lists('drops', left_out)}, 'owns': {lists('owns', f'case when {owner} then len(s.prose) + 1 else 0 end')}, 'prose': {prose}}}"
    first = "{'tags': []::varchar[], 'drops': []::boolean[], 'owns': []::bigint[], 'prose': []::varchar[]}"
    folded = f"list_reduce({parts}, lambda s, t: {step}, {first})"
    return f"select page_id, {sql_clean('prose')} as prose from (select page_id, array_to_string(({folded}).prose, chr(10)) as prose from pages)"


def _stripped(col: str) -> str:
    out = f"regexp_replace({col}, '<[^>]*>', '', 'g')"
    for name, char in html.ENTITIES:
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql_clean(out)


#: CTEs up to pv, the variants of pages.
SQL_VARIANTS = rf"""pg as materialized (select regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, html, array_to_string(regexp_extract_all(html, '(?s)<p\b[^>]*>(.*?)</p>', 1), chr(10)) as para,
  array_to_string(list_transform(regexp_extract_all(html, '(?s)<p\b[^>]*>.*?</p>|<h[1-6]\b[^>]*>.*?</h[1-6]>'), lambda x: case when starts_with(x, '<h') then '== ' || x || ' ==' else x end), chr(10)) as marked from pages),
pv as materialized (select lang, 'all' as variant, {HTML_ALL} as t from pg union all select lang, 'paragraphs', {_stripped('para')} from pg union all select lang, 'marked headings', {_stripped('marked')} from pg)"""


_SCRIPT = "case " + " ".join(f"when regexp_matches(word, '[{''.join(rf'\x{{{a:X}}}-\x{{{b:X}}}' for a, b in r)}]') then '{n}'" for n, r in script.BLOCKS) + " else 'Other' end"

ORACLES = {
    "words_per_lang": f"select lang, count(*) as n_docs, sum({sql_words('text')})::bigint as n_words from documents group by lang",
    "chars_words_lines_per_doc": f"with t as (select doc_id, {sql_clean('text')} as t from documents) select doc_id, length(t)::bigint as chars, {sql_words('t')}::bigint as words, len(string_split(t, chr(10)))::bigint as lines from t",
    "clean_text_hash": f"select doc_id, sha256({sql_clean('text')}) as sha256 from documents",
    "compatible_text_hash": f"select doc_id, sha256({sql_norm('text')}) as nfkc, sha256({sql_norm(f"translate(text, '{NARROW}', '{WIDE}')")}) as nfc from documents",
    "hash_split_counts": f"with t as (select lang, sha1(source || '/' || doc_id) as h, {sql_words('text')} as w from documents) select lang, case when {SHA_RESIDUE} = 0 then 'heldout' else 'train' end as split, count(*) as n_docs, sum(w)::bigint as n_words from t group by 1, 2",
    "min_words_filter": f"select source, count(*) as n_docs from documents where {sql_words('text')} >= 20 group by source",
    "title_exclusion": "select lang, count(*) as n_docs from documents where string_split(text, chr(10))[1] not in (select string_split(text, chr(10))[1] from benchmark) group by lang",
    "word_budget_prefix": f"with t as (select doc_id, lang, sha1(source || '/' || doc_id) as h, {sql_words('text')}::bigint as n_words from documents where {sql_words('text')} >= 20), s as (select doc_id, lang, case when {SHA_RESIDUE} = 0 then 'heldout' else 'train' end as split, n_words from t), b as (select *, coalesce(sum(n_words) over (partition by lang, split order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as words_before from s) select * from b where words_before < 5000",
    "first_sentence": f"with t as (select doc_id, regexp_extract_all(string_split(text, chr(10))[1], '[^{WS29}]+') as w from documents), e as (select doc_id, w, list_filter(range(6, len(w) + 1), lambda i: regexp_matches(w[i], '[.\\x{{964}}\\x{{6D4}}?!]$')) as ends from t) select doc_id, array_to_string(w[1:least(coalesce(ends[1], 18), 18)], ' ') as sentence from e",
    "script_of_words": f"with t as (select lang, unnest({sql_pretokens('text')}) as word from documents), c as (select lang, word, count(*) as n from t group by 1, 2) select lang, {_SCRIPT} as script, count(*) as n_words, sum(n)::bigint as n from c group by 1, 2",
    "page_links": r"""with t as (select page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref=["'']([^"'']*)["'']', 1)[1:5000] as l from pages) select page_id, unnest(range(len(l)))::bigint as place, unnest(l) as target from t""",
    "html_all_text": f"select page_id, sha256({HTML_ALL}) as sha256 from pages",
    "html_prose_text": _sql_prose(),
    "html_word_counts": f"with t as (select page_id, {HTML_ALL} as t from pages) select page_id, length(t)::bigint as chars, {sql_words('t')}::bigint as words from t",
    "scalar_functions": r"""with t as (select item_id, text as t from benchmark), w as (select *, string_split(t, ' ')[1:3] as w from t)
select item_id, replace(replace(url_encode(replace(t, ' ', '_')), '+', '%20'), '~', '%7E') as url, replace(replace(replace(replace('<a href="x">&' || t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped,
 case when len(w) < 2 then array_to_string(w, '') else array_to_string(w[1:len(w) - 1], ', ') || ' and ' || w[-1] end as spoken,
 regexp_replace(hex(encode(substr(t, 1, 1))), '(..)', '<0x\1>', 'g') as bytes, (length(t) // 7) || '.' || lpad(((length(t) % 7)::hugeint * 1000000000 // 7)::varchar, 9, '0') as ratio,
 regexp_matches(case when item_id % 2 = 0 then '▁' || chr(769) || t else t end, '^▁*[\p{M}\x{200C}\x{200D}]') as mark_first, length(t)::bigint as code_points from w""",
    "quality_join": f"select quality, count(*) as n_docs, sum(length({sql_norm('text')}) + 1)::bigint as chars, sum({sql_words('text')})::bigint as words, sum(length({sql_norm('text')}) + 1)::double / sum({sql_words('text')})::double as fertility from documents join labels using (doc_id) group by quality",
    "arrivals_per_window": f"with t as (select time_bucket(interval '1 hour', ts) as s, lang, {sql_words('text')} as w, length({sql_norm('text')}) + ({sql_norm('text')} <> '')::int as c from documents join events on event_id = doc_id) select strftime(s, '%Y-%m-%d %H:%M') as start, lang, count(*) as n_docs, sum(w)::bigint as n_words, sum(c)::bigint as n_chars, sum(c)::double / sum(w)::double as fertility from t group by s, lang",
}
