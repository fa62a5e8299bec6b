import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from cadenza.llm import hashing, private

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and max(map(int, value.split("."))) <= 255, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


ODD = [
    None, "", "no data", "a@b.c x@y@z.com, .@-.-.- a@b..c q@r.s.", "é@b.co ü+1 (988) 555-2485 or +1-2 +12345678901234567 +123456789.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 0255.00.1.1 1.2.3 10.0.0.1.", "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 5500005555555559 1 2 3",
    "+4111111111111111 a@1.2.3.4 111111111111111111111111111", "x" * 3000 + "@" + "y" * 10 + ".zz", "1" * 3000 + ".1.1.1 " + "9." * 500,
]


def test_base_spans_against_plain_patterns():
    for text in ODD:
        assert private.base_spans(text or "") == plain(text), text


SYMBOLS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def entropy(value):
    """Bits of one symbol."""
    return sum(n * math.log2(len(value) / n) for n in Counter(value).values()) / len(value)


def context(words):
    """Stands for the words around an entity, by which copies are told."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, stops, _ = hashing.words(data, np.array([0, len(data)]))
    found = int(np.bitwise_xor.reduce(hashing.mixed(hashing.hashes(data, starts, stops)))) if words else 0
    return found - (1 << 64) if found >> 63 else found


def brute(rows, window=private.WINDOW, threshold=private.THRESHOLD, least=private.BITS):
    """Added spans of each (key, text) by plain counting over all pairs."""
    pairs, firsts = Counter(), Counter()
    for _, text in rows:
        symbols = [chr(b) if chr(b) in SYMBOLS else None for b in (text or "").encode()]
        pairs.update(zip(symbols, symbols[1:], strict=False))
        firsts.update(symbols[:-1])
    bits = lambda a, b: -math.log2((pairs[a, b] + 1) / (firsts[a] + 65))
    texts = []
    for key, text in rows:
        text = text or ""
        spans = plain(text)
        for m in re.finditer("[A-Za-z0-9_-]+", text):
            inside = any(a < m.end() and m.start() < b for _, a, b in spans if _ != "secret")
            new = {*zip([None, *m[0]], m[0], strict=False)}
            if not inside and len(new) * entropy(m[0]) >= least and sum(bits(a, b) for a, b in new) >= least:
                spans = [*spans, ("secret", *m.span())]
        blank = list(text)
        for _, a, b in spans:
            blank[a:b] = " " * (b - a)
        terms = [(m.start(), m.end(), "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])) for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+", "".join(blank))]
        entities = {}
        for kind, a, b in spans:
            left, right = [t for *_, t in terms if _[0] < a], [t for *_, t in terms if _[0] >= b]
            near = left[-window:] + right[:window]
            for e in private._protected(kind, text[a:b]):
                old = entities.get(e)
                entities[e] = (min(context(near), old[0]) if old else context(near), {*near} | (old[1] if old else set()))
        texts.append((key, spans, terms, entities))
    n_t, n_e, both, beside = Counter(), defaultdict(set), defaultdict(list), defaultdict(list)
    for _, _, terms, entities in texts:
        held = {t for *_, t in terms}
        n_t.update(held)
        for e, (c, near) in entities.items():
            n_e[e].add(c)
            for t in held:
                both[e, t].append(c)
            for t in near:
                beside[e, t].append(c)
    everywhere, local = set(), set()
    for found, counted in ((both, everywhere), (beside, local)):
        for (e, t), contexts in found.items():
            p, n = len(n_e[e]) / len(texts), len(set(contexts))
            of = n_t[t] - len(contexts) + n
            after = (n - 1 + p) / of if counted is everywhere else (n + p) / (of + 1)
            if p < 1 and (counted is local or n > 1) and math.log(after / p) / -math.log(p) >= threshold:
                counted.add(t if counted is everywhere else (e, t))
    out = []
    for key, spans, terms, entities in texts:
        marked = [(a, b) for a, b, t in terms if t in everywhere or any((e, t) in local and t in near for e, (_, near) in entities.items())]
        out.append((key, [s[1:] for s in spans if s[0] == "secret"], marked))
    return out


def added(spark, rows, **parameters):
    found = private.spans(spark.createDataFrame(rows, "doc_id long, text string"), **parameters).collect()
    pairs = lambda c: [tuple(s) for s in c]
    return sorted(((r.doc_id, pairs(r.secrets), pairs(r.terms)) for r in found), key=str)


def test_added_spans_of_a_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = sorted(brute(docs), key=str)
    assert any(t for *_, t in expected)
    assert added(spark, docs) == expected
    based = {i for i, text in docs if plain(text)}
    assert all(i in based or s or not t for i, s, t in expected)


def test_planted_entities_are_caught_and_clean_documents_stay(spark):
    """50 names beside addresses that occur once or twice, and 20 keys; the rest of the corpus holds neither."""
    import random

    rng = random.Random(3)
    common = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(common, k=n))
    rows = [(i, prose(60)) for i in range(1500)]
    names = [f"Zo{''.join(rng.choices('klmnopq', k=8))}" for _ in range(50)]
    for k, name in enumerate(names):
        for copy in range(1 + k % 2):
            rows.append((2000 + 10 * k + copy, f"{prose(20)} {name} {prose(2)} user{k}@host{k}.org {prose(20)}"))
    for k in range(20):
        rows.append((5000 + k, f"{prose(20)} key = {''.join(rng.choices('0123456789abcdef', k=40))} {prose(20)}"))
    found = added(spark, rows)
    assert found == sorted(brute(rows), key=str)
    text = dict(rows)
    caught = {text[i][a:b] for i, _, terms in found for a, b in terms}
    assert len(caught & set(names)) >= 45
    assert sum(bool(s) for i, s, _ in found if i >= 5000) == 20
    assert all(not s and not t for i, s, t in found if i < 2000)


def test_long_texts_and_repeated_runs_are_no_secrets(spark):
    rows = [(1, "ab" * 200_000), (2, "word " * 200_000 + "é 9f8e7d6c5b4a39281706f5e4d3c2b1a0ffeeddcc end"), (3, None), (4, "x" * 60)] + [(10 + i, f"plain text number {i}") for i in range(40)]
    found = {i: s for i, s, _ in added(spark, rows)}
    at = rows[1][1].index("9f8e")
    assert found[2] == [(at, at + 40)] and not found[1] and not found[4]


def test_whole_table_base(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = private.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans == joined or r.spans.startswith(joined + "," if joined else ("term:", "secret:"))


def test_disclosing_terms(spark):
    who = "jo@ex.org"
    other = ["alpha", "bravo", "charlie", "delta", "echoes"]
    rows = [(i, f"Écrivez about {w} lighthouse then {who} said common {w}s today") for i, w in enumerate(other)]
    rows += [(10 + i, f"common said today then about plain{i}y") for i in range(40)]
    rows += [(60, f"far from it {who}"), (61, "copyonly ab@cd.ef"), (62, "copyonly ab@cd.ef"), (62, "copyonly ab@cd.ef"), (63, "copyonly ab@cd.ef"), (64, None), (None, "about lighthouse")]
    found = added(spark, rows)
    assert sorted({str(r) for r in found}) == sorted({str(r) for r in brute(rows)})
    marked = {i: {dict(rows)[i][a:b] for a, b in terms} for i, _, terms in found}
    assert all({"Écrivez", "lighthouse"} <= marked[i] for i in range(5)) and marked[None] == {"lighthouse"}
    assert not any(marked[10 + i] for i in range(40))
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, base int, spans string")
    clean = {r.doc_id: r for r in private.sanitised(docs).collect()}
    assert clean[0].text == "[TERM] about alpha [TERM] then [EMAIL] said common alphas today"
    assert clean[10].text == rows[5][1] and clean[64].text is None
    assert clean[0].base == 1 and private.sanitised(docs).count() == len(rows)
    assert private.sanitised(docs.limit(0)).collect() == []


def test_disclosing_terms_go_wherever_they_stand(spark):
    far = " ".join(f"filler{i}q" for i in "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, f"{w}x wrote {who} {w} {far} Lighthouse, é Lighthouse") for i, (w, who) in enumerate((w, "jo@ex.org") for w in ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"))]
    rows += [(200 + i, f"wrote é about {far} today") for i in range(140)] + [(90, "the lighthouse alone"), (None, "a LIGHTHOUSE"), (91, "lighthouse@ab.cd stays")]
    found = added(spark, rows)
    assert found == sorted(brute(rows), key=str)
    for i, _, terms in found:
        text = dict(rows)[i]
        assert {m.span() for m in re.finditer("lighthouse(?!@)", text, re.I)} <= set(terms), text
    clean = {r.doc_id: r.text for r in private.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[90] == "the [TERM] alone" and clean[None] == "a [TERM]" and clean[91].startswith("[EMAIL] ")


def test_entities_in_one_or_two_documents(spark):
    rows = [(i, f"{w}a of Ac {w}b wrote {w}@acme.co today {w}c") for i, w in enumerate(("ann", "bob", "cy"))]
    rows += [(10, "one yo left +1 (988) 555-2485 today"), (11, "two right yo +19885552485 of"), (12, "lonely once@only.net words")]
    rows += [(20 + i, f"plain{i}p of wrote today") for i in range(100)]
    found = added(spark, rows)
    assert found == sorted(brute(rows), key=str)
    for i, _, terms in found:
        assert {m.span() for m in re.finditer(r"\b(?:Ac|yo)\b", dict(rows)[i])} <= set(terms)
        assert i < 20 or not terms


def test_long_lists_of_values_and_words_make_no_square(spark):
    """Two documents that share 1,600 addresses and 8,000 words, among others: classes meet, not values and words."""
    import time

    shared = " ".join(f"user{i}@host{i}.example.org" for i in range(1600)) + " " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(8000))
    rows = [(1, "alpha " + shared), (2, "beta " + shared), *((i, f"plain text number {chr(97 + i % 26)} of some words") for i in range(3, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    bits = private.information(df)
    found = private.staged(private.base(df, bits))
    bad = private.disclosing(df, found, bits)
    everywhere = bad.where("NOT beside").select("term").distinct().count()
    assert everywhere >= 7000 and bad.where("NOT beside").count() < 3 * everywhere
    assert time.perf_counter() - began < 60
