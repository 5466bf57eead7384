"""Queries that write the files that the pipeline meets and read them back, with their oracles."""

from __future__ import annotations

import contextlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import html, text
from wordloom.plans import corpus_queries as base
from wordloom.plans import ledger_queries
from wordloom.plans.text_queries import HTML_ALL, SHA_RESIDUE, docs, sql_clean, sql_words
from wordloom.operators.prefix import ranged, with_offsets
from wordloom.session import scratch, table
from wordloom.sources import readers, run_log, sinks

CAPS = {"train": 6000, "heldout": 600}


def _titled(spark, sf_dir) -> DataFrame:
    """Documents with a title and an id that sorts like the number."""
    title = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), title.alias("title"), "text", "lang")


def documents_file(spark, sf_dir):
    """Documents by language and split as gzip JSON lines, read back cleaned and up to a word budget."""
    path = scratch(spark, "documents")
    sinks.write_documents(_titled(spark, sf_dir).withColumn("split", text.split_name(F.col("title"))), path)
    return readers.documents(spark, path, max_words=5000).select("lang", "split", "id", "title", F.sha2("text", 256).alias("sha256"))


def split_streams(spark, sf_dir):
    """Training and held-out documents from one scan, each up to its budget; short and excluded ones use none of it."""
    rows = _titled(spark, sf_dir)
    excluded = rows.where(F.col("id").cast("long") % 9 == 0)
    return readers.heldout_and_train(rows, excluded, CAPS).select("lang", "split", "id", F.col("n_words").cast("long").alias("n_words"))


def _raw(spark, sf_dir) -> DataFrame:
    """The benchmark's texts as raw pages."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(
        F.lit("en").alias("lang"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), F.col("item_id").alias("pageid"), (F.col("item_id") * 7 + 1).alias("revid"),
        F.lit("2026-01-02T03:04:05Z").alias("rev_timestamp"), text.url_title(F.concat(F.lit("Item "), F.col("item_id").cast("string"))).alias("url"), "text", F.lit("2026-01-03T00:00:00Z").alias("retrieved_utc"), F.lit("test").alias("source"),
    )


def _one_file_each(rows: DataFrame) -> DataFrame:
    """A table dealt so that no file has two rows."""
    names = rows.columns
    cut = ranged(rows.withColumn("_place", F.xxhash64(*names)).withColumn("_row", F.monotonically_increasing_id()), ["_place", "_row"])
    numbered = with_offsets(cut, [], ["_place", "_row"], F.lit(1), "_file")
    return numbered.repartitionById(max(1, cut.count()), F.col("_file").cast("int")).select(*names)


def raw_page_files(spark, sf_dir):
    """One JSON object per file, read back with hashes and counts of the cleaned text, the date and the file's kind."""
    path = scratch(spark, "raw")
    _one_file_each(_raw(spark, sf_dir)).write.option("compression", "gzip").json(path)
    rows = readers.raw_pages(spark, path)
    pages = rows.select("lang", "title", "revid", F.col("text").alias("raw"), text.clean_text(F.col("text")).alias("text"), F.to_date(F.substring("rev_timestamp", 1, 10)).alias("day"))
    made = sinks.snapshot_manifest(pages).join(pages.select("title", "day"), "title")
    return made.select("title", "revid", "clean_text_sha256", F.col("words").cast("long").alias("words"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def text_page_files(spark, sf_dir):
    """Whole text files without the newlines at their end."""
    path = scratch(spark, "texts")
    rows = table(spark, sf_dir, "benchmark").select(F.concat("text", F.lit("\n\n")).alias("value"))
    _one_file_each(rows).write.text(path)
    return readers.text_files(spark, path).select(F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


def html_page_files(spark, sf_dir):
    """Whole gzip HTML files, and the text that they hold."""
    path = scratch(spark, "html")
    _one_file_each(table(spark, sf_dir, "pages").select(F.col("html").alias("value"))).write.option("compression", "gzip").text(path)
    return readers.page_files(spark, path).select(F.sha2("html", 256).alias("html_sha256"), F.sha2(html.html_all(F.col("html")), 256).alias("text_sha256"))


def ledger_files(spark, sf_dir):
    """Runs appended to two ledgers in two goes, read back as one."""
    rows, paths = ledger_queries.full_ledger(spark, sf_dir).drop("seq"), [scratch(spark, "ledger") for _ in range(2)]
    for go in (0, 1):
        for path, mine in zip(paths, (F.startswith("stage", F.lit("D-")), ~F.startswith("stage", F.lit("D-"))), strict=True):
            sinks.append_runs(rows.where(mine & (F.crc32(F.col("id").cast("binary")) % 2 == go)), path)
    back = readers.ledger(spark, *paths)
    return back.select("id", "stage", F.col("result.spread").alias("spread"), F.size("result.heldout").cast("long").alias("n_heldout"), F.size("langs").cast("long").alias("n_langs"), F.col("result.eval")["en"]["tokens"].cast("long").alias("tokens"))


def committed_runs(spark, sf_dir):
    """Runs that two writers append at once and a third fails to: by stage, how many there are and how they are numbered."""
    rows, path = ledger_queries.full_ledger(spark, sf_dir).drop("seq"), scratch(spark, "committed")
    half = F.crc32(F.col("id").cast("binary")) % 2
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: run_log.append(rows.where(half == k), path), (0, 1)))
    with contextlib.suppress(PythonException, SparkRuntimeException):
        run_log.append(rows.withColumn("note", F.when(half == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("note"))), path)
    number = F.regexp_extract("run_id", r"-(\d+)$", 1).cast("long")
    return run_log.read(spark, path).groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("n_ids"), F.countDistinct("id").alias("n_runs"), F.min(number).alias("first"), F.max(number).alias("last"))


def tokenizer_file(spark, sf_dir):
    """A tokenizer saved and read back: its merges, and whether vocabulary and identity are the same."""
    path = scratch(spark, "tokenizer")
    vocab, merges = base._vocabulary(spark, sf_dir).select("id", "token", "kind"), base._merges(spark, sf_dir).select("rank", "left", "right")
    sinks.write_tokenizer(vocab, merges, path)
    model = spark.read.text(f"{path}/model", wholetext=True).select(F.regexp_replace("value", "\n$", "").alias("value"))
    head = '{"normalizer":{"type":"NFC"},"pre_tokenizer":{"type":"Metaspace"},"post_processor":null,"decoder":null,"model":'
    model.select(F.concat(F.lit(head), "value", F.lit("}")).alias("value")).coalesce(1).write.text(f"{path}/artifact")
    back_vocab, back, _ = readers.tokenizer_tables(spark, f"{path}/artifact")
    same = sinks.same_rows(back_vocab, vocab.select("id", "token")) and sinks.tokenizer_sha(back_vocab, back).first() == sinks.tokenizer_sha(vocab, merges).first()
    return back.select(F.col("rank").cast("int").alias("rank"), "left", "right", F.lit(same).alias("same"))


#: What a tokenizer file may say, by name: normalizer, pre-tokenizer, post-processor and the rest of its model.
HEADS = (
    ("as written", '{"type":"NFC"}', '{"type":"Metaspace"}', "null", '"type":"BPE"'),
    ("other forms", '{"type":"Sequence","normalizers":[{"type":"NFKC"},{"type":"Strip"}]}', '{"type":"Sequence","pretokenizers":[{"type":"Split"}]}', "null", '"type":"BPE"'),
    ("lower case", '{"type":"Lowercase"}', '{"type":"Metaspace"}', "null", '"type":"BPE"'),
    ("by bytes", '{"type":"NFC"}', '{"type":"Sequence","pretokenizers":[{"type":"Metaspace"},{"type":"ByteLevel"}]}', "null", '"type":"BPE"'),
    ("with a template", "null", "null", '{"type":"TemplateProcessing"}', '"type":"BPE"'),
    ("no merges", "null", "null", "null", '"type":"BPE","ignore_merges":true'),
    ("pieces", "null", "null", "null", '"type":"WordPiece"'),
)


def refused_tokenizers(spark, sf_dir):
    """Tokenizer files that ask for what the engine does not do, with the reasons, and how many tokens the others have."""
    base_path, made = scratch(spark, "heads"), []
    vocab = base._vocabulary(spark, sf_dir).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", F.col("id").cast("int")))))).alias("v"))  # a vocabulary
    for k, (name, normal, pre, post, model) in enumerate(HEADS):
        head = f'{{"normalizer":{normal},"pre_tokenizer":{pre},"post_processor":{post},"decoder":null,"model":{{{model},"merges":[],"vocab":'
        vocab.select(F.concat(F.lit(head), "v", F.lit("}}")).alias("value")).write.text(f"{base_path}{k}")
        try:
            made.append((name, "", readers.tokenizer_tables(spark, f"{base_path}{k}")[0].count()))
        except ValueError as e:
            made.append((name, str(e), None))
    return spark.createDataFrame(made, "name string, refused string, n_tokens long")


def configured_weights(spark, sf_dir):
    """Weights by language and source from a configuration file; names may have dots."""
    path = scratch(spark, "config")
    pairs = docs(spark, sf_dir).groupBy(F.concat(F.col("lang"), F.lit(".x")).alias("lang"), "source").agg((F.count("*") / F.lit(8.0)).alias("w"))
    entry = F.struct(F.concat("lang", F.lit("."), "source").alias("key"), F.col("w").alias("value"))
    pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("weights"), F.array_sort(F.collect_set("lang")).alias("langs")).coalesce(1).write.json(path)  # as large as the configuration
    return readers.weights(spark, path)


def changed_revisions(spark, sf_dir):
    """Pages whose live revision is not the pinned one: a manifest file joined with what is there now."""
    path, raw = scratch(spark, "manifest"), _raw(spark, sf_dir)
    pages = raw.select(F.col("title").alias("key"), F.struct(F.col("lang").alias("language"), "title", "pageid", "revid", F.sha2(text.clean_text(F.col("text")), 256).alias("clean_text_sha256")).alias("value"))
    pages.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("pages")).coalesce(1).write.json(path)  # a manifest names a few pages
    live = raw.select(F.col("title").alias("lang"), (F.col("revid") + F.when(F.col("pageid") % 3 == 0, 1).otherwise(0)).alias("live_revid"))
    met = readers.manifest(spark, path).join(live, "lang").select(F.col("lang").alias("page"), "revid", "live_revid", (F.col("revid") == F.col("live_revid")).alias("same_as_pinned"), "clean_text_sha256")
    return met.where("not same_as_pinned")


QUERIES = {f.__name__: f for f in (documents_file, split_streams, raw_page_files, text_page_files, html_page_files, ledger_files, committed_runs, tokenizer_file, refused_tokenizers, configured_weights, changed_revisions)}

_ID = "lpad(doc_id::varchar, 12, '0')"
_SPLIT = f"case when {SHA_RESIDUE} = 0 then 'heldout' else 'train' end as split"
ORACLES = {
    "documents_file": f"with t as (select {_ID} as id, source || '/' || doc_id as title, sha1(source || '/' || doc_id) as h, lang, {sql_clean('text')} as c from documents), s as (select lang, id, title, c, {_SPLIT}, {sql_words('c')}::bigint as n from t), b as (select *, coalesce(sum(n) over (partition by lang, split order by id rows between unbounded preceding and 1 preceding), 0) as before from s) select lang, split, id, title, sha256(c) as sha256 from b where before < 5000",
    "split_streams": f"""with t as (select {_ID} as id, sha1(source || '/' || doc_id) as h, lang, {sql_words(sql_clean('text'))}::bigint as n_words from documents where doc_id % 9 <> 0), s as (select lang, id, n_words, {_SPLIT} from t where n_words >= 20),
b as (select *, coalesce(sum(n_words) over (partition by lang, split order by id rows between unbounded preceding and 1 preceding), 0) as before from s) select lang, split, id, n_words from b where before < case split {' '.join(f"when '{k}' then {v}" for k, v in CAPS.items())} end""",
    "raw_page_files": f"with t as (select item_id, {sql_clean('text')} as c from benchmark) select 'Item ' || item_id as title, item_id * 7 + 1 as revid, sha256(c) as clean_text_sha256, {sql_words('c')}::bigint as words, '2026-01-02' as day from t",
    "text_page_files": "with t as (select rtrim(text, chr(10)) as c from benchmark) select sha256(c) as sha256, length(c)::bigint as chars from t",
    "html_page_files": f"select sha256(html || chr(10)) as html_sha256, sha256({HTML_ALL}) as text_sha256 from pages",
    "ledger_files": f"with {ledger_queries._FULL} select id, stage, spread, case when held then 4 else 0 end::bigint as n_heldout, 4::bigint as n_langs, n_chars::bigint as tokens from l",
    "committed_runs": f"with {ledger_queries._FULL} select stage, count(*) as n, count(*) as n_ids, count(distinct id) as n_runs, 1::bigint as first, count(*) as last from l group by stage",
    "tokenizer_file": f"""{base._RECURSIVE} select rank, "left", "right", true as same from m""",
    "refused_tokenizers": f"""{base._RECURSIVE}, {base._BASE} select name, refused, case when refused = '' then (select count(*) from v) end as n_tokens from (values ('as written', ''), ('other forms', ''), ('lower case', 'normalizer Lowercase'), ('by bytes', 'pre-tokenizer ByteLevel'), ('with a template', 'a post-processor'), ('no merges', 'ignored merges'), ('pieces', 'model WordPiece')) as x(name, refused)""",
    "configured_weights": "select lang || '.x' as lang, source, count(*) * 125000 as micro from documents group by 1, 2",
    "changed_revisions": f"select 'Item ' || item_id as page, item_id * 7 + 1 as revid, item_id * 7 + 2 as live_revid, false as same_as_pinned, sha256({sql_clean('text')}) as clean_text_sha256 from benchmark where item_id % 3 = 0",
}
