"""Personal data: fixed patterns, and bootstrapped contextual extraction that adds to them. Built-in functions only.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers. They are the seeds. What stands around an
entity induces lexical patterns: words in front of it, words behind it, and one of each. Anything that looks like an
identifier at all, whatever its spelling, is a candidate and induces the same patterns. Patterns and the distinct values that
they surround form a bipartite graph, which Spark scores in rounds: a pattern's confidence in a kind is the share of its
values that belong to the kind, each weighted by its own score; a candidate that stands in a trusted pattern and can be of
its kind takes the pattern's confidence as its score, and counts with that weight for all its other patterns in the next
round. So candidates that seeds' patterns discover make new patterns trusted, which discover more. Trusted patterns add
the candidates that they surround.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.native import let, running
from wordloom.session import checkpointed

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base as given, with matches started only where they can begin and possessive repeats: the same matches, in time
#: and stack that do not grow with the square of a long run.
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
_C = "[A-Za-z0-9@._%+:/()#\\[\\]-]"
#: A candidate in any spelling: words joined by bracketed words, or a word with a digit or @ and the numbers that follow it.
LOOSE = (
    f"(?<![A-Za-z0-9@._%+-])(?![A-Za-z_]+[:=])(?:[A-Za-z0-9][A-Za-z0-9._-]{{0,63}}(?: ?[\\[({{][A-Za-z]{{2,3}}[\\])}}] ?[A-Za-z0-9-]{{1,63}}){{1,6}}"
    f"|(?={_C}{{0,63}}[0-9@])[A-Za-z0-9+(]{_C}{{0,63}}(?<=[A-Za-z0-9)])(?: [(]?[0-9][0-9().-]{{0,30}}(?<=[0-9)])){{0,6}})"
)
#: A cheap test that a text can hold a match of the kind at all.
HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){13}", "phone": "\\+[0-9]"}
LOOSE_HINT = "[0-9@]|[\\[({][A-Za-z]{2,3}[\\])}]"
LEFT, RIGHT = 48, 32
SALTS = 16


@dataclass(frozen=True)
class Settings:
    """Rounds at most, the weight of distinct values that a pattern needs, and the confidence from which it is trusted."""

    rounds: int = 8
    support: float = 3.0
    confidence: float = 0.8


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, pair: Column) -> Column:
        doubled = pair["d"] * 2
        return total + F.when(pair["i"] % 2 == 1, doubled - F.when(doubled > 9, 9).otherwise(0)).otherwise(pair["d"])

    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.struct(F.coalesce(x.try_cast("int"), F.lit(0)).alias("d"), i.alias("i")))
    return F.aggregate(each, F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """The test that a match of the base has to pass."""
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) == 0) | ((F.length(q) <= 3) & (q.try_cast("int") <= 255))))
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _fits(value: Column) -> Column:
    """The kinds that a candidate can be of at all, as bits: by its digits, letters and separators, not by its spelling."""
    digits, letters = F.length(_digits(value)), value.rlike("[A-Za-z]")
    tests = (letters & value.rlike("[@\\[({]"), (digits >= 3) & (F.length(F.regexp_replace(value, "[^.:]", "")) >= 3), ~letters & digits.between(12, 19), ~letters & digits.between(7, 15))
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


_SPAN = "array<struct<start:int,kind:int,end:int,fits:int,left:string,right:string,value:string>>"


def _found(text: Column, kind: str | None) -> Column:
    """Spans of a kind of the base, or of candidates, with what stands around them; nothing is worked out for a text without
    a hint. fits is -1 in spans of the base."""
    pattern, hint = (BASE[kind], HINT[kind]) if kind else (LOOSE, LOOSE_HINT)

    def spans(matches: Column, between: Column) -> Column:
        def build(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start, before, after = starts[i * 2 + 1], between[i], between[i + 1]
                left = F.when((F.length(before) >= LEFT) | (i == 0), before).otherwise(F.concat(matches[F.greatest(i - 1, F.lit(0))], before))
                right = F.when((F.length(after) >= RIGHT) | (i + 1 >= F.size(matches)), after).otherwise(F.concat(after, matches[F.least(i + 1, F.size(matches) - 1)]))
                return F.struct(
                    start.alias("start"),
                    F.lit(KINDS.index(kind) if kind else -1).alias("kind"),
                    (start + F.length(m)).alias("end"),
                    (F.lit(-1) if kind else _fits(m)).cast("int").alias("fits"),
                    F.right(left, F.lit(LEFT)).alias("left"),
                    F.left(right, F.lit(RIGHT)).alias("right"),
                    m.alias("value"),
                )

            return F.filter(F.transform(matches, one), lambda s: _holds(kind, s["value"]) if kind else s["fits"] > 0)

        lengths = F.flatten(F.zip_with(between, F.concat(matches, F.array(F.lit(""))), lambda b, m: F.array(F.length(b), F.length(m))))
        return let(running(lengths), build)

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda b: spans(m, b))).otherwise(F.array().cast(_SPAN)))
    return F.when(text.rlike(hint), every).otherwise(F.array().cast(_SPAN))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, base, loose): spans by start, then kind; positions are code points, end exclusive. loose spans are
    candidates that touch no span of the base; their kind is -1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*[_found(text, k) for k in KINDS]))
    made = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), base.alias("base"), _found(text, None).alias("loose"))
    apart = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return made.select("uid", "doc_id", "base", F.when((F.size("loose") > 0) & (F.size("base") > 0), apart).otherwise(F.col("loose")).alias("loose"))


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns around a value, lower-cased, digits as 0: the last word in front if it is a cue that ends in : = or #,
    the last two and three words, the first two words behind, and the words next to it on both sides."""

    def words(text: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def made(a: Column, b: Column) -> Column:
        n, m = F.size(a), F.size(b)
        last, first = F.element_at(a, -1), F.element_at(b, 1)
        cue = F.when((n >= 1) & F.get(a, n - 1).rlike("^[^0-9]{2,}[:=#]$"), F.concat(F.lit("cue "), last))
        more = [F.when(n >= k, F.concat(F.lit(f"in front {k} "), F.array_join(F.slice(a, -k, k), " "))) for k in (2, 3)]
        behind = F.when(m >= 2, F.concat(F.lit("behind 2 "), F.array_join(F.slice(b, 1, 2), " ")))
        around = F.when((n >= 1) & (m >= 1), F.concat_ws(" ", F.lit("around"), last, F.lit("_"), first))
        return F.array_distinct(F.array_compact(F.array(cue, *more, behind, around)))

    return let(words(left), lambda a: let(words(right), lambda b: made(a, b)))


def _salted(few: DataFrame) -> DataFrame:
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")


def trusted_patterns(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(pattern, kind, confidence) of the patterns in found, the rows of entities, that end up trusted.

    The graph has a row per pattern and distinct value; repeats count once, so a group of copies weighs as one document.
    Patterns around fewer values than their support are left out at once. A round sends two numbers to the driver; rounds end
    when one discovers the same values with the same scores as the one before. Joins are salted, so that a frequent pattern or value is dealt
    to many tasks.
    """
    if settings.rounds < 1:
        raise ValueError("rounds must be at least 1")
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    each = spans.select("s.kind", "s.fits", F.xxhash64(F.lower("s.value")).alias("value"), F.explode(_patterns(F.col("s.left"), F.col("s.right"))).alias("pattern"))
    every = checkpointed(each.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits")))
    wide = every.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= settings.support)
    edges = checkpointed(every.withColumn("salt", F.pmod("value", F.lit(SALTS))).join(_salted(wide), ["pattern", "salt"]).drop("salt"))
    seeds = edges.where("kind >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    loose = edges.where("kind < 0").withColumn("salt", F.pmod("value", F.lit(SALTS))).select("pattern", "value", "fits", "salt")
    scores, before = seeds, (0, 0)
    for _ in range(settings.rounds):
        dealt = edges.select("pattern", "value", "n", F.pmod(F.xxhash64("pattern"), F.lit(SALTS)).alias("salt"))
        worth = dealt.join(_salted(scores), ["value", "salt"]).groupBy("pattern", "kind").agg(F.sum("score").alias("support"), F.first("n").alias("n"))
        sure = worth.select("pattern", "kind", "support", (F.col("support") / (F.col("n") + 0.5)).alias("confidence")).where((F.col("support") >= settings.support) & (F.col("confidence") >= settings.confidence))
        trusted = checkpointed(sure.select("pattern", "kind", "confidence"))
        met = loose.join(_salted(trusted), ["pattern", "salt"]).where(F.expr("fits & (1 << kind)") > 0)
        best = met.groupBy("value").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
        discovered = checkpointed(best.select("value", (-F.col("b.k")).alias("kind"), F.col("b.confidence").alias("score")))
        now = discovered.agg(F.count("*"), F.coalesce(F.sum(F.floor(F.col("score") * 1_000_000)), F.lit(0))).first()
        if now == before:
            break
        scores, before = seeds.unionByName(discovered), now
    return trusted


def discover(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(uid, added): the candidates that a trusted pattern of a kind that they can be of surrounds, as that kind; of several
    patterns the one of highest confidence, then the kind listed first."""
    loose = found.where(F.size("loose") > 0).select("uid", F.explode("loose").alias("s"))
    each = loose.select("uid", "s", F.explode(_patterns(F.col("s.left"), F.col("s.right"))).alias("pattern")).withColumn("salt", F.pmod("uid", F.lit(SALTS)))
    met = each.join(_salted(patterns), ["pattern", "salt"]).where(F.expr("s.fits & (1 << kind)") > 0)
    best = met.groupBy("uid", F.col("s.start").alias("start")).agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"), F.col("s.end").alias("end"))).alias("b"))
    span = F.struct("start", (-F.col("b.k")).alias("kind"), F.col("b.end").alias("end"))
    return best.groupBy("uid").agg(F.collect_list(span).alias("added"))


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (base and discovered), n_discovered.

    A null text counts as empty: no spans, and the hash of the empty string. Repeated rows and null ids stay; an empty
    table gives no rows; other columns are not read. Texts of any length are read whole; a word of a candidate has at most
    64 characters.
    """
    found = checkpointed(entities(docs))
    added = discover(found, trusted_patterns(found, settings))
    short = "array<struct<start:int,kind:int,end:int>>"
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    met = found.select("uid", "doc_id", base.alias("base")).join(added.hint("merge"), "uid", "left").withColumn("added", F.coalesce("added", F.array().cast(short)))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(k) for k in range(len(KINDS))]
    return met.select("doc_id", *counts, F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_discovered"))
