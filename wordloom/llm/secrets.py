"""Secret scan: token candidates by pattern, false positives removed by a random forest. Built-in functions only.

The forest is trained with Spark's own learner on labelled findings and then written out as a few array literals, so that
scoring is a projection inside the scan: no shuffle, no Python, and the texts are read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.native import let, running
from wordloom.session import checkpointed

_TOKEN = "[A-Za-z0-9+/_-]"
CONTEXT = 64
BEFORE = CONTEXT // 2  # so many candidates with what is between them fill a context
FEATURES = ("length", "transitions", "digits", "uppers", "distinct", "dictionary", "hexadecimal", "assigned", "plain_word", "path", "prefix", "repeat", "quoted", "symbols", "literal")
#: Dictionary of words that identifiers and prose are made of.
WORDS = (
    "access account action address admin alpha api app archive area article asset auth author backup bank base batch beta block blog board body book box branch browser bucket build button cache "
    "call card case cell change channel chapter chart check child city class client cloud code color column comment commit common company config connection contact content control copy core count country course "
    "custom customer data date debug default demo design detail device digest directory document domain draft dummy edit email end engine entry error event example export fast feature field figure file filter final "
    "find first fixture folder form format frame free from front full game general graph green group guide hash head health help high history home host house icon image import index info input "
    "item job key label language large last layer layout level library license light line link list load local lock log login long machine main make manager map mark master match media member memory menu "
    "message meta method mobile mock mode model module month move music name network news next node normal note number object office online open option order output owner package page panel paper part "
    "password patch path payment people phone photo place placeholder plan player plugin point policy port post power press print private process product profile program project public query queue random range rate read record "
    "reference region release remote report request resource response result review right room root row rule sample save schema score screen script search second section secret security select send sequence series "
    "server service session set setting shop short show side site size small snapshot sort source space stage staging start state static status step stock store story street string style sub summary support system table "
    "tag target task team temp template test text theme thread time title token tool topic total track train tree type unit update upload user value version video view volume web week weight white "
    "window word work world year zone"
).split()
KEYWORD = "(?i)(password|passwd|pwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer|signature)"
_ASSIGNED = KEYWORD + "[\"'A-Za-z0-9_. -]{0,16}(?:[:=]{1,2}|=>|\\bis\\b|\\bbearer\\b)[ \\t]*[\"'`(]?$"
_PLAIN_WORD = "(?i)(commit|revision|sha-?1|sha-?256|md5|checksum|digest|etag|uuid|guid|build|version|release|example|sample|dummy|placeholder|fixture|session id|order|invoice|isbn|serial|model|part no)[\"': #=.()-]*[\"'`]?$"
_LITERAL = "(?i)^(null|none|nil|true|false|undefined|empty|required|optional|string|str|bytes|yes|no|on|off|enabled|disabled|hidden|redacted|missing|invalid|expired|unknown|default|todo)$|^[$%<{\\[]|[.(\\[*]{3}|^[a-z_]+[.(\\[][a-z_]"
_PREFIX = "^(AKIA|ASIA|ghp_|gho_|ghs_|sk_live_|rk_live_|sk-|xox[abp]-|AIza|glpat-|npm_|eyJ)"
#: The value after a key word and : or =, in quotes up to the closing one, else up to a blank, a quote or the next name,
#: without closing punctuation. The short looks back come first, as they fail at once in prose.
_GIVEN = KEYWORD + "[\"'A-Za-z0-9_. -]{0,16}(?:=>|[:=]{1,2})[ \t]{0,4}"
_VALUE = "(?![=:>])(?=[^\\s\"'`]{4})(?:[^\\s\"'`.,;:&?)\\]}>]++|(?![,;&][A-Za-z_.-]{1,32}+ ?[=:])[.,;:&?)\\]}>]++(?=[^\\s\"'`.,;:&?)\\]}>]))++"
_QUOTED = [f"(?<={_GIVEN}{q})[^{q}\\r\\n]{{4,}}+(?={q})" for q in "\"'`"]
_GIVEN_VALUE = f"(?<=[:=> \\t\"'`(])(?<=[:=>][ \\t]{{0,4}}[\"'`(]?)(?:{'|'.join(_QUOTED)}|(?<={_GIVEN}[\"'`(]?){_VALUE})"
_ISSUED = f"(?<!{_TOKEN})(?:{_PREFIX[2:-1]}){_TOKEN}{{12,}}+"
#: Given values, issued keys, and runs of token characters with a digit and a letter; each run is looked at once, whatever
#: its length.
CANDIDATE = f"{_GIVEN_VALUE}|{_ISSUED}|(?<!{_TOKEN})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_TOKEN}{{8,}}+"


def features(token: Column, left: Column, right: Column) -> Column:
    """array<double> of FEATURES of a token between its neighbours."""
    n = F.length(token).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "0"), "[+/_-]", "+")

    def flag(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    def gone(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(token, pattern, ""))) / n

    runs = F.length(F.regexp_replace(kinds, "(.)\\1*+", "x")) - 1
    covered = (n - F.length(F.regexp_replace(F.lower(token), "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), ""))) / n
    return F.array(
        F.least(n, F.lit(200.0)),
        runs / n,
        gone("[0-9]"),
        gone("[A-Z]"),
        F.size(F.array_distinct(F.split(token, ""))) / F.least(n, F.lit(64.0)),
        covered,
        flag(token.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        flag(left.rlike(_ASSIGNED)),
        flag(left.rlike(_PLAIN_WORD)),
        flag(F.contains(token, F.lit("/")) | left.rlike("(://[^ ]*|[/\\\\.])$") | right.rlike("^[.](?:com|org|net|io|html?|png|jpe?g|gif|css|js|py|json|txt|pdf|zip)\\b|^[:\\\\]")),
        flag(token.rlike(_PREFIX)),
        flag(token.rlike("(.)\\1{3}|(?i)1234|abcd|xxx|qwert")),
        flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        gone("[^A-Za-z0-9+/_ -]"),
        flag(token.rlike(_LITERAL)),
    )


def labelled_findings(spark: SparkSession, n: int = 6000, seed: str = "findings") -> DataFrame:
    """(token, left, right, label): findings whose label is known from how they were made, the same ones every time.

    Secrets are random keys and passwords in assignments, in quotes or bare with an issuer's prefix; false positives are checksums,
    commit ids, UUIDs, versions, paths, slugs, identifiers of dictionary words, placeholders,
    literals, expressions and short words after a key word.
    """
    i = F.col("id").cast("string")

    def h(k: str) -> Column:
        return F.sha2(F.concat(F.lit(f"{seed} {k} "), i), 256)

    def pick(k: str, values: list[str]) -> Column:
        options = F.split(F.lit("\x01".join(values)), "\x01")  # one literal, however many values
        return F.element_at(options, (F.pmod(F.xxhash64("id", F.lit(f"{seed} {k}")), F.lit(len(values))) + 1).cast("int"))

    def word(k: str) -> Column:
        return pick(k, list(WORDS))

    def sound(k: str) -> Column:
        return pick(k, ["cor", "rect", "hor", "bat", "ter", "mon", "pur", "lan", "dri", "vok", "kel", "tis", "hun", "pas", "swor", "gib", "rin", "fal", "zup", "mel"])

    def mixed(k: str, size: int) -> Column:
        return F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(k), h(k + "'")))), "[+/=]", ""), 1, size)

    def hexed(k: str, size: int) -> Column:
        return F.substring(h(k), 1, size)

    upper = F.upper(F.regexp_replace(mixed("u", 40), "[^A-Za-z0-9]", ""))
    key = pick("key", ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "secret_key", "auth_token", "client_secret", "DB_PASSWORD", "API-KEY"])
    glue = pick("glue", ["=", " = ", ": ", ' = "', '="', ": '", '": "'])
    end = F.when(F.substring(glue, -1, 1).isin('"', "'"), F.substring(glue, -1, 1)).otherwise(pick("end", ["", " ", "\n", ".", ","]))
    prose = F.concat(word("p1"), F.lit(" "), word("p2"), F.lit(" "))
    digits = F.pmod(F.xxhash64("id", F.lit("d")), F.lit(10000)).cast("string")
    no = F.lit("")
    cases = [  # token, left, right, label
        (hexed("a", 18), F.concat(prose, key, glue), end, 1),
        (hexed("a", 40), F.concat(prose, key, glue), end, 1),
        (hexed("a", 32), F.concat(prose, key, glue), end, 1),
        (mixed("a", 20), F.concat(prose, key, glue), end, 1),
        (mixed("a", 40), F.concat(prose, key, glue), end, 1),
        (mixed("a", 12), F.concat(prose, key, glue), end, 1),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), prose, pick("end", ["", " ", "\n", ".", ","]), 1),
        (F.concat(pick("pre", ["ghp_", "sk_live_", "glpat-", "npm_", "AIza"]), mixed("a", 32)), prose, no, 1),
        (hexed("a", 40), F.concat(prose, pick("w", ["commit ", "revision ", "commit: ", "sha1: ", "SHA1 (", "etag: \""])), no, 0),
        (hexed("a", 64), F.concat(prose, pick("w", ["sha256:", "digest: ", "checksum ", "sha256="])), no, 0),
        (hexed("a", 32), F.concat(prose, pick("w", ["md5:", "md5 ", "checksum = "])), no, 0),
        (F.concat_ws("-", hexed("a", 8), hexed("b", 4), hexed("c", 4), hexed("d", 4), hexed("e", 12)), F.concat(prose, pick("w", ["uuid ", "", "id ", "request "])), no, 0),
        (F.concat_ws("-", word("a"), word("b"), digits), prose, no, 0),
        (F.concat_ws("_", word("a"), word("b"), digits), F.concat(prose, pick("w", ["", "name = \"", "item: "])), no, 0),
        (F.concat_ws("/", word("a"), word("b"), digits, word("c")), F.concat(prose, pick("w", ["", "https://host.example", "./"])), pick("x", [".html", ".png", "", ".py"]), 0),
        (F.concat_ws("-", F.lit("2024"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), word("a")), F.concat(prose, pick("w", ["version ", "release ", ""])), no, 0),
        (F.concat(word("a"), digits), F.concat(prose, key, glue, no), end, 0),
        (F.concat(pick("y", ["your-", "my-", "example-", "changeme", "xxxxxxxx", "test-"]), word("a"), pick("z", ["1", "123", "1234", "0000"])), F.concat(prose, key, glue), end, 0),
        (F.concat(word("a"), word("b"), digits), prose, no, 0),
        (hexed("a", 12), prose, no, 0),
        (F.concat(F.initcap(sound("a")), pick("s1", ["@", "0", "$", "3", "1"]), sound("b"), pick("s2", ["!", "#", "!x", "9!", "?z", "*"])), F.concat(prose, key, glue), end, 1),
        (F.concat(sound("a"), pick("s1", ["3", "0", "1", "4"]), sound("b"), pick("s2", ["2", "7", "x9", "42"])), F.concat(prose, key, glue), end, 1),
        (F.concat(*[sound(k) for k in "abcde"], pick("s2", ["", "ver", "pol"])), F.concat(prose, key, glue), end, 1),
        (F.concat_ws(" ", *[F.concat(sound(k), sound(k + "'")) for k in "abc"]), F.concat(prose, key, pick("glue", [' = "', '="', '": "'])), F.lit('"'), 1),
        (F.substring(F.regexp_replace(h("n"), "[a-f]", ""), 1, 9), F.concat(prose, key, glue), end, 1),
        (F.concat(F.lit("AKIA"), F.substring(F.regexp_replace(upper, "[0-9]", ""), 1, 16)), prose, pick("end", ["", " ", "\n", ".", ","]), 1),
        (F.concat(pick("pre", ["npm_", "sk-", "ghp_"]), word("a"), pick("j", ["_", "-"]), word("b"), pick("j", ["_", "-"]), word("c")), prose, no, 0),
        (pick("v", ["null", "None", "true", "false", "required", "string", "undefined", "redacted", "********", "enabled", "optional", "invalid"]), F.concat(prose, key, glue), end, 0),
        (F.concat(pick("v", ["$", "${", "<", "{{", "os.environ.", "settings.", "self.", "getenv("]), word("a"), F.lit("_"), word("b")), F.concat(prose, key, glue), end, 0),
        (F.concat(word("a"), pick("z", ["", "s"])), F.concat(prose, key, glue), end, 0),
        (F.concat(sound("a"), sound("b")), F.concat(prose, key, glue), end, 0),
        (F.concat_ws(" ", word("a"), word("b"), word("c")), F.concat(prose, key, pick("glue", [' = "', '="', '": "'])), F.lit('"'), 0),
    ]
    made = None  # a small plan per case: one for all would be too large to compile
    for k, (token, left, right, label) in enumerate(cases):
        part = spark.range(k, n, len(cases), 1).select(token.alias("token"), left.alias("left"), right.alias("right"), F.lit(label).alias("label"))
        made = part if made is None else made.unionByName(part)
    run = F.col("token").rlike(f"^{_TOKEN}{{8,}}$") & F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")
    return made.where((F.length("token") >= 4) & (run | F.col("left").rlike(_ASSIGNED) | F.col("token").rlike(_PREFIX)))


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of equal depth, end to end: the feature and the limit of each inner node, the vote of each
    leaf. A value up to the limit goes left. As arrays the forest is a few literals, however many trees it has."""

    depth: int
    feature: tuple[int, ...]
    limit: tuple[float, ...]
    vote: tuple[float, ...]

    def score(self, f: Column) -> Column:
        """The share of trees that vote 1, for an array<double> of FEATURES."""
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        feature, limit, vote = F.lit(list(self.feature)), F.lit(list(self.limit)), F.lit(list(self.vote))

        def ballot(tree: Column) -> Column:
            def down(node: Column, _: Column) -> Column:
                at = tree * inner + node
                return node * 2 + F.when(f[feature[at]] <= limit[at], 1).otherwise(2)

            return vote[F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), down) - inner + tree * leaves]

        trees = len(self.vote) // leaves
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), ballot), F.lit(0.0), lambda s, v: s + v) / trees


def fitted(findings: DataFrame, trees: int = 15, depth: int = 5, seed: int = 11) -> RandomForestClassificationModel:
    """Spark's random forest over findings (token, left, right, label)."""
    table = findings.select(features(F.col("token"), F.col("left"), F.col("right")).alias("f"), F.col("label").cast("double").alias("label"))
    wide = table.select("label", *[F.col("f")[i].alias(name) for i, name in enumerate(FEATURES)])
    wide = checkpointed(wide.coalesce(1))  # a small table; the learner reads it several times
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=5).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide))


def train(findings: DataFrame, trees: int = 15, depth: int = 5, seed: int = 11) -> Forest:
    """A forest over findings, grown by Spark's learner."""
    return forest_of(fitted(findings, trees, depth, seed), depth)


def forest_of(model: RandomForestClassificationModel, depth: int) -> Forest:
    """The model's trees, each filled up to the full depth: a leaf above it stands for all leaves below."""
    trees = [tree._java_obj.rootNode() for tree in model.trees]
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, limit, vote = [0] * (inner * len(trees)), [float("inf")] * (inner * len(trees)), [0.0] * (leaves * len(trees))

    def fill(tree: int, node, at: int, level: int) -> None:
        if node.subtreeDepth() == 0:
            first = (at + 1 << depth - level) - leaves
            vote[tree * leaves + first : tree * leaves + first + (1 << depth - level)] = [node.prediction()] * (1 << depth - level)
            return
        feature[tree * inner + at], limit[tree * inner + at] = node.split().featureIndex(), node.split().threshold()
        fill(tree, node.leftChild(), 2 * at + 1, level + 1)
        fill(tree, node.rightChild(), 2 * at + 2, level + 1)

    for k, root in enumerate(trees):
        fill(k, root, 0, 0)
    return Forest(depth, tuple(feature), tuple(limit), tuple(vote))


_trained: dict[str, Forest] = {}


def standard_forest(spark: SparkSession) -> Forest:
    """The forest over labelled_findings, grown once per application."""
    name = spark.sparkContext.applicationId
    if name not in _trained:
        _trained[name] = train(labelled_findings(spark))
    return _trained[name]


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Per row of docs: row, a struct of its columns; findings, array<struct<start,end,token,score,secret>> of every candidate in
    its whole text, by start; and between, the pieces of text around them. Null texts count as empty. Positions are code
    points, end exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = "array<struct<start:int,end:int,token:string,score:double,secret:boolean>>"

    def scored(tokens: Column, between: Column) -> Column:
        def build(starts: Column, tails: Column) -> Column:
            def one(token: Column, i: Column) -> Column:
                left = F.right(F.array_join(F.slice(tails, F.greatest(i * 2 + 1 - 2 * BEFORE, F.lit(1)), F.least(i * 2 + 1, F.lit(2 * BEFORE + 1))), ""), F.lit(CONTEXT))
                f = features(token, left, F.substring(between[i + 1], 1, 16))
                start = starts[i * 2 + 1]
                return let(f, lambda f: let(forest.score(f), lambda s: F.struct(start.alias("start"), (start + F.length(token)).alias("end"), token.alias("token"), s.alias("score"), (s >= threshold).alias("secret"))))

            return F.transform(tokens, one)

        pieces = F.flatten(F.zip_with(between, F.concat(tokens, F.array(F.lit(""))), lambda b, m: F.array(b, m)))
        lengths, ends = F.transform(pieces, F.length), F.transform(pieces, lambda p: F.right(p, F.lit(CONTEXT)))
        return let(running(lengths), lambda starts: let(ends, lambda tails: build(starts, tails)))

    def both(tokens: Column) -> Column:
        return let(F.split(text, CANDIDATE, -1), lambda b: F.struct(scored(tokens, b).alias("findings"), b.alias("between")))

    none = F.struct(F.array().cast(kind).alias("findings"), F.array(text).alias("between"))
    made = let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda t: F.when(F.size(t) > 0, both(t)).otherwise(none))
    return docs.select(F.struct("*").alias("row"), made.alias("scan")).select("row", "scan.findings", "scan.between")


def secret_scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_secrets, top_score (0 without a candidate), spans (start:end of secrets, comma-joined).

    One row per row of docs: nulls count as empty texts, repeats and null ids stay, an empty table gives no rows, other
    columns are not read, texts of any length are read whole.
    """
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), forest or standard_forest(docs.sparkSession), threshold)
    secret = F.filter("findings", lambda x: x["secret"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secret).cast("long").alias("n_secrets"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
        F.array_join(F.transform(secret, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )


def redacted(docs: DataFrame, forest: Forest | None = None, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with each secret in text replaced by mark and n_chars, if there, made to fit; documents without stay as they are.
    Nulls, repeats, empty tables and clashing names pass as in secret_scan, under docs' own names."""
    found = scan(docs, forest or standard_forest(docs.sparkSession), threshold)
    shown = F.concat(F.transform("findings", lambda x: F.when(x["secret"], F.lit(mark)).otherwise(x["token"])), F.array(F.lit("")))
    clean = F.array_join(F.flatten(F.zip_with("between", shown, lambda b, s: F.array(b, s))), "")
    out = found.select("row", F.exists("findings", lambda x: x["secret"]).alias("has"), F.when(F.exists("findings", lambda x: x["secret"]), clean).alias("clean"))
    made = {"text": F.when(F.col("has"), F.col("clean")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("has"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
