"""Text, script and HTML functions on literal and on random cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from wordloom.functions import html, script, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


WORDS = [
    ("Artificial intelligence is changing the world", 6),
    ("भारत दक्षिण एशिया में स्थित है।", 6),
    ("భారతదేశం దక్షిణ ఆసియాలో ఉంది.", 4),
    ("بھارت جنوبی ایشیا میں واقع ایک ملک ہے۔", 8),
    ("a b c  d\n\ne", 5),
    ("जवाहर‌लाल", 1),
    ("", 0),
    (" \t", 0),
]


@pytest.mark.parametrize(("value", "n"), WORDS)
def test_word_counts(spark, value, n):
    assert one(spark, value, text.count_words) == n == len(value.split())


def test_three_kinds_of_white_space(spark):
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(chars)], "i int, t string")
    got = rows.select("i", text.count_words(F.col("t")).alias("p"), text.count_words(F.col("t"), text.WHITE_SPACE).alias("u")).collect()
    assert {r.i for r in got if r.p == 2} == {i for i, c in enumerate(chars) if c.isspace()}
    assert {r.i for r in got if r.u == 2} == {i for i, c in enumerate(chars) if c.isspace() and c not in "\x1c\x1d\x1e\x1f"}


CLEAN = [
    ("a\r\nb", "a\nb"),
    ("a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\nb\nc\nd\ne\nf\ng\nh\ni"),
    (" a\x1f  b \n\n \n c", "a b\nc"),
    ("é", "é"),
    ("", ""),
    ("\U0001d4b3 x", "\U0001d4b3 x"),
]


@pytest.mark.parametrize(("value", "want"), CLEAN)
def test_clean_text(spark, value, want):
    assert one(spark, value, text.clean_text) == want
    assert one(spark, want, text.clean_text) == want


def test_normal_forms(spark):
    values = ["é", "é", "ﬁ", "क़", "क़", "plain", "", "ﬁx", "²"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", text.normal_form(F.col("t")).alias("c"), text.normal_form(F.col("t"), "NFKC").alias("k"))
    assert all(r.c == unicodedata.normalize("NFC", r.t) and r.k == unicodedata.normalize("NFKC", r.t) for r in rows.collect())
    with pytest.raises(ValueError, match="normal form"):
        text.normal_form(F.col("t"), "NFD")


def test_pretokens_cut_in_front_of_marks(spark):
    cut = lambda c: text.pretokens(text.normalized(c))
    assert one(spark, "▁a ▁▁b", cut) == ["▁a", "▁", "▁", "▁b"]
    assert one(spark, "  a  b ", cut) == ["▁a", "▁b"]
    assert one(spark, "", cut) == one(spark, " ", cut) == []


def test_punctuation_pieces(spark):
    pieces = lambda c: F.flatten(F.transform(text.pretokens(c), text.punctuation_pieces))
    assert one(spark, "Hi, (x", pieces) == ["▁Hi", ",", "▁(", "x"]


def test_hash_split_is_sha1_modulo_ten(spark):
    import hashlib

    titles = [f"title {i} é" for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", text.hash_residue(F.col("t")).alias("r"), text.split_name(F.col("t")).alias("s")).collect()
    for r in rows:
        want = int(hashlib.sha1(r.t.encode()).hexdigest(), 16) % 10
        assert r.r == want and r.s == ("heldout" if want == 0 else "train")


def test_first_sentence(spark):
    assert one(spark, "One two. three four five six. seven\nx", text.first_sentence) == "One two. three four five six."
    assert one(spark, " ".join("abcdefghijklmnopqrstuvw"), text.first_sentence) == " ".join("abcdefghijklmnopqr")
    assert one(spark, "a b", text.first_sentence) == "a b"


def test_truncation_does_not_round(spark):
    row = spark.range(1).select(text.truncated_ratio(F.lit(17292), F.lit(11672), 18).alias("r"), text.truncated_ratio(F.lit(1), F.lit(0), 3).alias("n")).first()
    assert row.r == "1." + str((17292 % 11672) * 10**18 // 11672).zfill(18) and row.n is None


def test_small_strings(spark):
    row = spark.range(1).select(text.spoken_list(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("l"), text.spoken_list(F.array(F.lit("a"))).alias("o"), text.url_title(F.lit("a b/ü")).alias("u"), text.html_escape(F.lit('<&">')).alias("h"), text.byte_tokens(F.lit("é")).alias("b")).first()
    assert (row.l, row.o, row.u, row.h, row.b) == ("a, b and c", "a", "a_b%2F%C3%BC", "&lt;&amp;&quot;&gt;", ["<0xC3>", "<0xA9>"])


UNITS = [
    ("शक्ति", ["श", "क्ति"]),
    ("स्वतंत्रता", ["स्व", "तं", "त्र", "ता"]),
    ("క్ష", ["క్ష"]),
    ("స్వాతంత్ర్యం", ["స్వా", "తం", "త్ర్యం"]),
    ("क्‍ष", ["क्‍ष"]),
    ("क्‌ष", ["क्‌", "ष"]),
    ("இந்தியா", ["இ", "ந்", "தி", "யா"]),
    ("abc", ["a", "b", "c"]),
    ("́a", ["́", "a"]),
    ("क्త", ["क्", "త"]),
    ("", []),
]


@pytest.mark.parametrize(("word", "units"), UNITS)
def test_aksharas_two_ways(spark, word, units):
    assert one(spark, word, script.aksharas) == units == script.akshara_list(word)


def test_aksharas_agree_on_random_words(spark):
    rng = random.Random(8)
    blocks = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
    words = set()
    for block in blocks:
        old = [c for c in map(chr, range(block, block + 0x80)) if unicodedata.ucd_3_2_0.category(c) == unicodedata.category(c)]  # Java's tables are older
        letters = [c for c in old if unicodedata.category(c) == "Lo"]
        marks = [c for c in old if unicodedata.category(c)[0] == "M"]
        joiner = [m for m in marks if unicodedata.combining(m) == 9][:1]
        for _ in range(150):
            kinds = rng.choices([letters, marks, joiner, ["\u200c", "\u200d", "a", "1"]], weights=[6, 2, 4, 1], k=rng.randint(1, 9))
            words.add("".join(rng.choice(k) for k in kinds))
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "t string").select("t", script.aksharas(F.col("t")).alias("a")).collect()
    assert len(rows) > 1000
    assert all(r.a == script.akshara_list(r.t) for r in rows), [(r.t, r.a, script.akshara_list(r.t)) for r in rows if r.a != script.akshara_list(r.t)][:3]


def test_bad_splits_and_marks(spark):
    row = spark.range(1).select(script.bad_splits(script.aksharas(F.lit("शक्ति")), F.array(F.lit("शक"), F.lit("्ति"))).alias("bad"), script.bad_splits(script.aksharas(F.lit("शक्ति")), F.array(F.lit("श"), F.lit("क्ति"))).alias("good"), script.starts_with_mark(F.lit("▁्क")).alias("m"), script.starts_with_mark(F.lit("▁क")).alias("n")).first()
    assert (row.bad, row.good, row.m, row.n) == (1, 0, True, False)


def test_scripts_and_kinds(spark):
    for word, want in (("a1", "Latin"), ("1", "Digits"), ("क", "Devanagari"), ("తె", "Telugu"), ("ملک", "Arabic"), ("▁", "Other"), ("ß", "Latin")):
        assert one(spark, word, script.script_of) == want
    kinds = spark.range(6).select(script.token_kind(F.col("id"), 1, 2, 1).alias("k")).collect()
    assert [r.k for r in kinds] == ["special", "char", "char", "akshara", "learned", "learned"]


def test_manifest_of_page_files(spark, tmp_path):
    import hashlib
    import json

    from wordloom.sources import readers, sinks

    raw = "\u0915\u094d\u0937  x\r\n\n\u00a0y e\u0301\u2028z "
    want = "\u0915\u094d\u0937 x\ny \u00e9\nz"
    (tmp_path / "a.json").write_text(json.dumps({"lang": "hi", "title": "t", "pageid": 1, "revid": 7, "text": raw}, indent=1), encoding="utf-8")
    pages = readers.raw_pages(spark, str(tmp_path / "*.json"))
    made = sinks.snapshot_manifest(pages.select("lang", "title", "revid", F.col("text").alias("raw"), text.clean_text(F.col("text")).alias("text"))).first()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (made.raw_extract_sha256, made.clean_text_sha256, made.file_sha256) == (sha(raw), sha(want), sha(want + "\n"))
    assert (made.chars, made.words, made.lines) == (len(want), 5, 3)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.json").write_text(json.dumps({"made": "x", "pages": {"hi": {"title": "t", "revid": 7, "words": 5, "clean_text_sha256": sha(want)}}}))
    known = readers.manifest(spark, str(tmp_path / "m" / "manifest.json")).first()
    assert (known.lang, known.words, known.clean_text_sha256) == ("hi", 5, made.clean_text_sha256)


def test_all_text_of_pages(spark):
    page = '<html><head><style>x{}</style><script>a<b</script></head><body><p>A &amp; b<!-- c --><br>d</p>e&nbsp;f</body></html>'
    assert one(spark, page, html.html_all) == "A & b\nd\ne f"
    rooted = '<p>out</p><div class="x mw-parser-output"><p>in <b>bold</b></p><script>s</script></div><p>after</p>'
    assert one(spark, rooted, html.html_all) == "in\nbold"


def test_prose_of_pages(spark):
    page = (
        '<h1>T</h1><h2>Head<span class="mw-editsection">edit</span></h2><p>One<sup class="reference">1</sup> <b>two</b>.</p><table><tr><td><p>no</p></td></tr></table>'
        '<ul><li>a<ul><li>b</li></ul></li><li><p>c</p></li></ul><div class="navbox"><p>nav</p></div><sup>kept?</sup>'
    )
    assert one(spark, page, html.html_prose) == "Head\nOne two.\nab\nb\nc"


def test_links(spark):
    assert one(spark, '<a class="k" href="/x">x</a><A HREF="/no"><a href=\'/y\'>', html.links) == ["/x", "/no", "/y"]


def test_references_decode_alike_with_and_without_a_root(spark):
    text = "caf&eacute; &#233; &#x1F600; &amp;lt; &hellip; a&nbsp;b &copy; R&D"
    want = "café é 😀 &lt; … a b © R&D"
    assert one(spark, f"<p>{text}</p>", html.html_all) == want == one(spark, f'<div class="mw-parser-output"><p>{text}</p></div>', html.html_all)


