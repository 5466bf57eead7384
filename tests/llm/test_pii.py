import hashlib
import random
import re

import pytest

from wordloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def listing(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(rows, texts):
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in want) for k in range(4)), texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(listing(want).encode()).hexdigest()
        assert set(filter(None, listing(want).split(","))) <= set(r.spans.split(","))


def test_base_equals_plain_patterns(spark):
    rng = random.Random(9)
    bits = ["a", "b.c", "@", ".", "1", "25", "255", "256", "4111 1111 1111 1111", "-", " ", "+1 (555) 555-0100", "_", "%", "𝒳", "é", "\n", "+", "4012888888881881", "x@y.z"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(1500)]
    texts += [None, "", "1" * 30000, "a" * 30000 + "@", "a@" * 5000, "1.2.3.4 " * 3000, "a@b.c_d@e.f", "000.00255.1.1", "+" + "1" * 12 + "((", "+1 2", "12 " * 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    check(rows, dict(enumerate(texts)))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    want = plain_discoveries(texts.items())  # these texts put identifiers anywhere, so patterns are few
    assert {r.doc_id: r.spans for r in rows} == {i: listing(sorted({*plain(t), *want.get(i, ())})) for i, t in texts.items()}


def plain_patterns(left, right):
    a, b = (re.sub("[0-9]", "0", x.lower()).split() for x in (left, right))
    out = {"cue " + a[-1]} if a and re.search("^[^0-9]{2,}[:=#]$", a[-1]) else set()
    out |= {f"in front {k} " + " ".join(a[-k:]) for k in (2, 3) if len(a) >= k}
    out |= {"behind 2 " + " ".join(b[:2])} if len(b) >= 2 else set()
    return out | ({f"around {a[-1]} _ {b[0]}"} if a and b else set())


def plain_fits(v):
    digits, letters = len(re.findall("[0-9]", v)), bool(re.search("[A-Za-z]", v))
    return {k for k, ok in enumerate((letters and re.search(r"[@\[({]", v), digits >= 3 and len(re.findall("[.:]", v)) >= 3, not letters and 12 <= digits <= 19, not letters and 7 <= digits <= 15)) if ok}


def surrounded(text, spans):
    """(span, left, right): the stretch up to the match before or behind, with that match if the stretch is short."""
    spans = sorted(spans)
    for i, (a, e) in enumerate(spans):
        before, after = text[spans[i - 1][1] if i else 0 : a], text[e : spans[i + 1][0] if i + 1 < len(spans) else len(text)]
        left = before if len(before) >= pii.LEFT or not i else text[spans[i - 1][0] : a]
        right = after if len(after) >= pii.RIGHT or i + 1 == len(spans) else text[e : spans[i + 1][1]]
        yield (a, e), left[-pii.LEFT :], right[: pii.RIGHT]


def plain_discoveries(rows, settings=pii.Settings()):
    """doc_id -> discovered spans (start, kind, end), by a graph in dictionaries."""
    around, kind_of, fits, at = {}, {}, {}, []
    for i, text in rows:
        text, base = text or "", plain(text)
        for k, pattern in enumerate(PLAIN.values()):
            every = [m.span() for m in re.finditer(pattern, text)]
            for (a, e), left, right in surrounded(text, every):
                if (a, k, e) in base:
                    v = text[a:e].lower()
                    kind_of[v] = max(k, kind_of.get(v, -1))
                    for p in plain_patterns(left, right):
                        around.setdefault(p, {})[v] = max(k, around.get(p, {}).get(v, -1))
        for (a, e), left, right in surrounded(text, [m.span() for m in re.finditer(pii.LOOSE, text)]):
            v = text[a:e].lower()
            if plain_fits(v) and not any(x < e and a < y for x, _, y in base):
                fits[v] = plain_fits(v)
                at.append((i, a, e, v, plain_patterns(left, right)))
                for p in at[-1][4]:
                    around.setdefault(p, {}).setdefault(v, -1)
    around = {p: vs for p, vs in around.items() if len(vs) >= settings.support}
    seeds = {(v, k): 1.0 for vs in around.values() for v, k in vs.items() if k >= 0}
    scores, before = seeds, (0, 0)
    for _ in range(settings.rounds):
        trusted = {}
        for p, vs in around.items():
            for k in range(4):
                support = sum(scores.get((v, k), 0.0) for v in vs)
                if support >= settings.support and support / (len(vs) + 0.5) >= settings.confidence:
                    trusted[p, k] = support / (len(vs) + 0.5)
        found = {}
        for p, vs in around.items():
            for v in (v for v, k in vs.items() if k < 0):
                found[v] = max([found.get(v, (0, 0)), *((trusted[p, k], -k) for k in fits[v] if (p, k) in trusted)])
        found = {v: x for v, x in found.items() if x[0]}
        now = (len(found), sum(int(c * 1_000_000) for c, _ in found.values()))
        if now == before:
            break
        scores, before = seeds | {(v, -k): c for v, (c, k) in found.items()}, now
    out = {}
    for i, a, e, v, patterns in at:
        best = max(((trusted[p, k], -k) for p in patterns for k in fits[v] if (p, k) in trusted), default=None)
        if best:
            out.setdefault(i, set()).add((a, -best[1], e))
    return out


def chained_corpus():
    """Texts in which three patterns follow from each other: seeds and looser spellings stand behind 'phone:', those and others
    behind 'dial extension', and those and the hidden ones behind 'reach desk'."""
    rng = random.Random(3)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [f"{word()} phone: +1 (555) 555-{1000 + i} {word()}" for i in range(1500)]
    for n, cues in ((250, ("phone:", "dial extension")), (40, ("dial extension", "reach desk"))):
        for _ in range(n):
            own = number()
            texts += [f"{word()} {cue} {own} {word()}" for cue in cues]
    hidden = [f"{word()} reach desk {number()} {word()}" for _ in range(6)]
    junk = [f"{word()} {word()} {number()} {word()}" for _ in range(60)] + [f"order code {number()} shipped" for _ in range(30)]
    return texts + hidden + junk, range(len(texts), len(texts) + len(hidden)), range(len(texts) + len(hidden), len(texts) + len(hidden) + len(junk))


def test_discoveries_support_further_patterns(spark):
    texts, hidden, junk = chained_corpus()
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain_discoveries(list(enumerate(texts)))
    assert {i: r.spans for i, r in rows.items()} == {i: listing(sorted({*plain(t), *want.get(i, ())})) for i, t in enumerate(texts)}
    assert all(rows[i].n_discovered == 1 for i in hidden)  # recall behind the third pattern: 1
    assert not any(rows[i].n_discovered for i in junk)  # precision: 1
    one = {r.doc_id: r.n_discovered for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pii.Settings(rounds=1)).collect()}
    assert not any(one[i] for i in hidden) and sum(one.values()) > 0  # without rounds, only what seeds reach


@pytest.mark.parametrize("seed", [1, 2])
def test_discoveries_equal_a_plain_graph(spark, seed):
    rng = random.Random(seed)
    cues = ["mail: ", "ip address is ", "card # ", "call me at ", "see ", "id= ", "", "host (", "a b c "]
    values = {
        0: lambda: rng.choice([f"u{rng.randint(0, 60)}@x.org", f"u{rng.randint(0, 60)} [at] x [dot] org", f"u{rng.randint(0, 9)}@x"]),
        1: lambda: rng.choice([f"10.0.{rng.randint(0, 20)}.{rng.randint(0, 300)}", f"fe80::{rng.randint(0, 9)}:1:{rng.randint(0, 99)}"]),
        2: lambda: rng.choice(["4111 1111 1111 1111", f"4111 1111 1111 {rng.randint(1000, 9999)}"]),
        3: lambda: rng.choice([f"+1 555 555 {rng.randint(1000, 9999)}", f"(555) 555-{rng.randint(1000, 9999)}", f"555.{rng.randint(100, 999)}.1234"]),
    }
    texts = [" ".join(f"{rng.choice(['', 'x ', 'we '])}{cues[c]}{values[c % 4 if rng.random() < 0.9 else rng.randint(0, 3)]()}{rng.choice(['', '.', ')', ' now please', ', thanks'])}" for c in [rng.randrange(len(cues)) for _ in range(rng.randint(0, 4))]) for _ in range(900)]
    settings = pii.Settings(rounds=4, support=2.0, confidence=0.25)
    want = plain_discoveries(list(enumerate(texts)), settings)
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), settings).collect()
    check(rows, dict(enumerate(texts)))
    assert {r.doc_id: r.spans for r in rows} == {i: listing(sorted({*plain(t), *want.get(i, ())})) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 50


def test_an_unreliable_pattern_discovers_nothing(spark):
    texts = [f"the id: +1 (555) 555-01{i:02d} x" for i in range(10, 14)] + [f"the id: 555-555-02{i:02d} x" for i in range(10, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(r.n_discovered for r in pii.personal_data(docs).collect()) == 0


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_nulls_repeats_empty(spark, rounds):
    docs = spark.createDataFrame([(1, None, "x"), (1, "a@b.c", "x"), (1, "a@b.c", "x"), (None, "", "x")], "doc_id long, text string, spans string")
    got = pii.personal_data(docs, pii.Settings(rounds=rounds)).collect()
    assert sorted(r.spans for r in got) == ["", "", "email:0:5", "email:0:5"]
    assert pii.personal_data(docs.where("false")).collect() == []
