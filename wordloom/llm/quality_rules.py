"""Quality rules as a bitmask ledger, with built-in functions only.

Every rule is evaluated once. The ledger keeps the measurements and a bit per failed rule; a policy is a versioned mask
of the rules that count, so changing a policy or asking what a rule removes reads the ledger, never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.native import let, words_of

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition over the measurements that fails a document; its bit is its place in RULES."""

    name: str
    fails: str


#: Bits 0 and 1 are the base rules. Conditions are whole-number SQL, so that any engine gives the same bits.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 15 * n_words or word_chars < 2 * n_words"),
    Rule("exclamations", "2 * n_exclamations > n_words"),
    Rule("upper_case", "10 * n_upper > 6 * word_chars"),
    Rule("one_word", "n_words >= 50 and 20 * n_distinct_words < n_words"),
    Rule("stutter", "5 * n_stutters > n_words"),
)
BASE = 0b11
#: Policy versions: bits that a kept document must not have. v1 is the base alone.
POLICIES = {"v1": BASE, "v2": (1 << len(RULES)) - 1}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_upper", "n_distinct_words", "n_stutters")


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more in the text."""

    def covered(found: Column) -> Column:
        """found: sorted start places of the repeated windows."""
        return F.aggregate(found, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, at: F.struct((at + WINDOW).alias("end"), (s["n"] + at + WINDOW - F.greatest(s["end"], at)).alias("n")), lambda s: s["n"])

    def places(marked: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            before, after = marked[F.greatest(i - 1, F.lit(0))], marked[F.least(i + 1, F.size(marked) - 1)]
            return ((i > 0) & (before["h"] == x["h"])) | ((i < F.size(marked) - 1) & (after["h"] == x["h"]))

        return F.sort_array(F.transform(F.filter(marked, same), lambda x: x["at"]))

    def count(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(let(marked, places)))

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(each) - WINDOW + 1), lambda i: F.xxhash64(F.slice(each, i, WINDOW)))

    return F.when(F.size(words) >= WINDOW, let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)).otherwise(F.lit(0))


def _count_of(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements (long) and failed, the bits of the failed rules, for each row of docs.

    A null text counts as empty: no words, so few_words fails. Repeated rows and null ids stay; an empty table gives no
    rows; other columns are not read. Windows are compared by 64-bit hashes of their words' 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def measure(words: Column) -> Column:
        return let(
            lines,
            lambda full: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
                _count_of(text, "[#*$%&|<>]").cast("long").alias("n_symbols"),
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"),
                F.size(full).cast("long").alias("n_lines"),
                _count_of(text, "!").cast("long").alias("n_exclamations"),
                _count_of(text, "[A-Z]").cast("long").alias("n_upper"),
                F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
                F.size(F.filter(words, lambda w, i: (i > 0) & (w == words[F.greatest(i - 1, F.lit(0))]))).cast("long").alias("n_stutters"),
            ),
        )

    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), let(words_of(text), measure).alias("m")).select("doc_id", "m.*")
    bits = [f"case when {r.fails} then {1 << k} else 0 end" for k, r in enumerate(RULES)]
    return measured.withColumn("failed", F.expr(" + ".join(bits)).cast("long"))


def apply_policy(ledgered: DataFrame, policy: int) -> DataFrame:
    """The ledger with base_failed and kept: no bit of the base nor of the policy."""
    return ledgered.withColumn("base_failed", F.col("failed").bitwiseAND(BASE) != 0).withColumn("kept", F.col("failed").bitwiseAND(policy | BASE) == 0)


def ablations(ledgered: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those that only this rule removes; one pass over bits.

    Columns: policy, rule, n_docs, n_kept, n_failed, n_only (long). Documents with equal bits are counted first, so at
    most 2^rules rows go on.
    """
    counts = ledgered.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for p, m in policies.items() for k, r in enumerate(RULES) if m >> k & 1]
    rows = counts.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("failed", "n", "c.*")
    within = F.col("failed").bitwiseAND(F.col("mask"))

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))

    return rows.groupBy("policy", "rule").agg(F.sum("n").alias("n_docs"), total(within == 0).alias("n_kept"), total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(within == F.col("bit")).alias("n_only"))


def quality_rules(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """doc_id, n_words, the base measurements, base_failed and kept, then the ledger's bits and further measurements."""
    first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rest = [m for m in MEASURES if m not in first]
    return apply_policy(ledger(docs), POLICIES[policy]).select("doc_id", *first, "base_failed", "kept", F.col("failed").alias("failed_rules"), *rest)


#: DuckDB SQL of quality_rules over documents.
ORACLE_SQL = """
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
win as (select rid, i as pos, array_to_string(ws[i:i+7], ' ') as g from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w)),
twice as (select rid, pos from (select rid, pos, count(*) over (partition by rid, g) as n from win) where n > 1),
cover as (select rid, count(distinct p) as n from (select rid, unnest(range(pos, pos + 8)) as p from twice) group by rid),
m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             coalesce(c.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines, len(regexp_extract_all(text, '!'))::bigint as n_exclamations,
             len(regexp_extract_all(text, '[A-Z]'))::bigint as n_upper, len(list_distinct(ws))::bigint as n_distinct_words,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::bigint as n_stutters
      from w left join cover c on c.rid = w.rid),
b as (select *, (@BITS)::bigint as failed_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules % 4 <> 0 as base_failed,
       failed_rules = 0 as kept, failed_rules, n_lines, n_exclamations, n_upper, n_distinct_words, n_stutters from b
""".replace("@BITS", " + ".join(f"case when {r.fails} then {1 << k} else 0 end" for k, r in enumerate(RULES)))

#: DuckDB SQL of ablations over the ledger of documents.
ABLATIONS_SQL = ORACLE_SQL[: ORACLE_SQL.rindex("select doc_id")].rstrip() + f""",
c as (select * from (values {", ".join(f"('{p}', {m}, '{r.name}', {1 << k})" for p, m in POLICIES.items() for k, r in enumerate(RULES) if m >> k & 1)}) as v(policy, mask, rule, bit))
select policy, rule, count(*) as n_docs, count(*) filter (failed_rules & mask = 0) as n_kept, count(*) filter (failed_rules & bit <> 0) as n_failed, count(*) filter (failed_rules & mask = bit) as n_only
from b, c group by policy, rule
"""
