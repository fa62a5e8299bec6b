"""Personal data: base patterns, values that carry too much information, and terms that disclose either.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and
non-overlapping for each kind; matches that fail their check (range, digits, checksum) are dropped.

Secrets: a run of letters, digits, _ and - is a span of kind "secret" where its self-information is BITS or more, both
by the corpus (each symbol given the one before, counted over all texts) and by the run itself (the entropy of its
symbols). Each different pair of neighbours in the run counts once. Words stay far below: they are predictable from
the corpus, and what repeats itself is predictable from the run. Random keys are neither.

Information-theoretic sanitisation: a protected entity is a base value or secret, however written, or the part that
it shares with others (mail name, mail domain, network, card issuer, phone exchange), so values that occur once
take part by what they have in common. Over the corpus, with N documents, n(e) that hold entity e, n(t) that
hold term t and n(t, e) that hold both, anywhere in the text,

    p(e) = n(e) / N,  p(e | t) = (n(t, e) - 1 + p(e)) / n(t),  disclosure(t, e) = log(p(e | t) / p(e)) / -log(p(e))

is the share of e's information that t reveals: the pointwise mutual information over the entity's own, where
p(e | t) is what the other documents with t tell about any one of them, smoothed by one document at p(e). It
comes near 1 for a term that never occurs without e, sooner the rarer e is: for e in 1 of 5,000 documents two
are enough; and where a text is the only one to hold t and e, nothing else links them and it is not above 0.
In a text that holds e the term counts itself as evidence: for terms that stand beside e (WINDOW terms on each
side), in n'(t, e) texts,

    p'(e | t) = (n'(t, e) + p(e)) / (n(t) + 1)

so a rare name beside a mail address is removed there even where both occur once.

Rows that hold e among equal terms (WINDOW on each side) are copies and count once in n(e), n(t) and n(t, e);
near copies that differ there count as different. A term whose disclosure by p of any entity reaches THRESHOLD is
a span of kind "term" wherever it occurs, in documents with and without base spans; one that reaches it by p' alone
is a span wherever it occurs in the documents where it stands beside that entity. `sanitised` generalises each
span to a placeholder.

All counts cover all documents. The corpus is read four times: for the symbols' counts (a table of 65 by 65);
for base spans, secrets, and the distinct terms of
documents that have any; for n(t), where each task sends one count per term; and for the places of disclosing
terms. The last two send only terms that may be wanted (a bitmap of fixed size).

Defined results: null text is empty. Texts of any length are read whole, by pieces. Ties don't arise: a span's kind and
place are unique. A secret that overlaps a base span isn't one. Terms are runs of ASCII letters and non-ASCII characters, with A-Z
lower-cased, of any length; base spans lie between terms. Repeated rows are separate documents with equal spans. An empty
table gives an empty result. Columns beside doc_id and text pass through `sanitised` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import hashing
from cadenza.llm.common import MAP_BITS, staged, table, values

WINDOW = 10
THRESHOLD = 0.8
BITS = 100.0
#: Numbers of texts by which common terms are told before they are paired with entities.
LEVELS = tuple(4**i for i in range(1, 9))
KINDS = ("email", "ip", "card", "phone")
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "term": "[TERM]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting inside a run of digits can't match where its start doesn't, so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_OTHER = re.compile(r"[^0-9]+")

#: Terms end at ASCII characters other than letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: The symbols of secrets, each with its number; any other byte has the number OTHER.
OTHER = 64
SYMBOLS = np.full(256, OTHER, np.int64)
SYMBOLS[[*range(65, 91), *range(97, 123), *range(48, 58), 95, 45]] = np.arange(OTHER)


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", domain.end() if domain else at + 1)
    return found


def _is_ip(value: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in value.split("."))


def _is_card(value: str) -> bool:
    digits = _OTHER.sub("", value)
    if not 13 <= len(digits) <= 19:
        return False
    doubled = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def _is_phone(value: str) -> bool:
    return 9 <= len(_OTHER.sub("", value)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern, passes in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if passes(m[0])]
    return found


def information(docs: DataFrame) -> np.ndarray:
    """Bits of each symbol (column) after another (row), over all texts; the whole of it is 65 by 65 numbers."""
    size = OTHER + 1

    def run(batches):
        counts = np.zeros(size * size, np.int64)
        for batch in batches:
            data, offsets = hashing.buffers(batch["text"])
            for first, last in hashing.pieces(offsets):
                low, high = int(offsets[first]), int(offsets[last])
                ends = np.unique(offsets[first + 1 : last])
                for at in range(low, high, hashing.PIECE):  # a long text by parts that overlap in one byte
                    symbols = SYMBOLS[data[at : min(at + hashing.PIECE + 1, high)]]
                    pairs = symbols[:-1] * size + symbols[1:]
                    pairs = np.delete(pairs, ends[(ends > at) & (ends <= at + len(pairs))] - at - 1)  # not across texts
                    counts += np.bincount(pairs, minlength=size * size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["pair", "n"])

    found = docs.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size * size)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(size, size)
    return -np.log2((counts + 1) / (counts.sum(1, keepdims=True) + size))


def is_secret(value: bytes, bits: np.ndarray, least: float) -> bool:
    symbols = SYMBOLS[np.frombuffer(value, np.uint8)]
    n = np.bincount(symbols)
    n = n[n > 0]
    pairs = np.unique(np.append(OTHER, symbols[:-1]) * (OTHER + 1) + symbols)
    if len(pairs) * (n * np.log2(len(symbols) / n)).sum() / len(symbols) < least:
        return False
    return bits.ravel()[pairs].sum() >= least


def _secrets(texts: pa.Array, bits: np.ndarray, least: float) -> list[list[tuple[str, int, int]]]:
    """The secrets of each text. A run of n symbols carries n log2(n) bits at most, which short ones can't reach."""
    shortest = next(n for n in range(1, 1 << 20) if n * np.log2(min(n, OTHER)) >= least)
    data, offsets = hashing.buffers(texts)
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    for first, last in hashing.pieces(offsets):
        part, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, stops, words = hashing.words(part, bounds, SYMBOLS == OTHER)
        for i in np.flatnonzero(stops - starts >= shortest).tolist():
            a, b = int(starts[i]), int(stops[i])
            if is_secret(part[a:b].tobytes(), bits, least):
                owner = int(np.searchsorted(bounds, a, "right")) - 1
                at = int(((part[bounds[owner] : a] & 0xC0) != 0x80).sum())
                found[first + owner].append(("secret", at, at + b - a))
    return found


def _key(value: str) -> int:
    found = xxhash.xxh3_64_intdigest(value)
    return found - (1 << 64) if found >> 63 else found


def _terms(texts: pa.Array, spans: list[list[tuple[str, int, int]]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, term, start, stop) of all terms in order, by pieces; terms end where a base span starts."""
    data, offsets = hashing.buffers(texts)
    data = data.copy()
    for i, text in enumerate(values(texts)):
        at, last = int(offsets[i]), 0
        for _, a, b in sorted(spans[i], key=lambda s: s[1]) if spans[i] else ():
            at, last = at + len(text[last:a].encode("utf-8")), a
            data[at : at + b - a] = 32  # base spans are ASCII
    for first, last in hashing.pieces(offsets):
        part = hashing.LOWER[data[offsets[first] : offsets[last]]]
        bounds = offsets[first : last + 1] - offsets[first]
        starts, stops, words = hashing.words(part, bounds, _BETWEEN)
        owner = np.repeat(np.arange(first, last), words)
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        origin = points[bounds[owner - first]]
        yield owner, hashing.hashes(part, starts, stops), points[starts] - origin, points[stops] - origin


def _spans_of(texts: pa.Array, bits: np.ndarray, least: float) -> list[list[tuple[str, int, int]]]:
    """Base spans and secrets of each text."""
    found = [base_spans(t) if t else [] for t in values(texts)]
    for spans, more in zip(found, _secrets(texts, bits, least), strict=True):
        spans += [s for s in more if not any(a < s[2] and s[1] < b for _, a, b in spans)]
    return found


def _protected(kind: str, value: str) -> list[str]:
    """The entities of a base value: itself, however written, and the part it shares with others."""
    if kind == "email":
        name, domain = value.lower().rsplit("@", 1)
        parts = [f"{name}@{domain}", f"{name}@", f"@{domain}"]
    elif kind == "ip":
        numbers = [n.lstrip("0") or "0" for n in value.split(".")]
        parts = [".".join(numbers), ".".join(numbers[:3])]
    elif kind == "secret":
        parts = [value]
    else:
        digits = _OTHER.sub("", value)
        parts = [digits, f"{digits[:6]}-" if kind == "card" else f"{digits[:-4]}-"]
    return [f"{kind}:{part}" for part in parts]


def _entities(text: str, spans: list[tuple[str, int, int]], terms: np.ndarray, starts: np.ndarray, stops: np.ndarray, window: int) -> list[dict]:
    """The entities of a text: each with a hash of the terms around it, by which copies are told, and those terms with all their places in the text."""
    found: dict[int, int] = {}
    beside: dict[int, set] = {}
    for kind, a, b in spans:
        left, right = np.searchsorted(starts, a), np.searchsorted(starts, b)
        near = terms[max(0, left - window) : right + window]
        context = int(np.bitwise_xor.reduce(hashing.mixed(near))) if near.size else 0
        context -= (1 << 64) if context >> 63 else 0
        for entity in map(_key, _protected(kind, text[a:b])):
            found[entity] = min(found.get(entity, context), context)
            beside.setdefault(entity, set()).update(near.tolist())
    every = np.array(sorted(set().union(*beside.values())), np.uint64)
    at = np.flatnonzero(np.isin(terms, every))
    places: dict[int, list] = {}
    for term, start, stop in zip(terms[at].tolist(), starts[at].tolist(), stops[at].tolist(), strict=True):
        places.setdefault(term, []).append({"start": start, "stop": stop})
    signed = lambda t: t - (1 << 64) if t >> 63 else t
    return [{"entity": e, "context": c, "near": [{"term": signed(t), "places": places[t]} for t in sorted(beside[e])]} for e, c in found.items()]


_PLACES = "array<struct<start:bigint,stop:bigint>>"
_PLACES_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ONE = f"struct<entity:bigint,context:bigint,near:array<struct<term:bigint,places:{_PLACES}>>>"
_ONE_ARROW = pa.struct(
    [("entity", pa.int64()), ("context", pa.int64()), ("near", pa.list_(pa.struct([("term", pa.int64()), ("places", _PLACES_ARROW)])))]
)


def base(docs: DataFrame, bits: np.ndarray, window: int = WINDOW, least: float = BITS) -> DataFrame:
    """(doc_id, text_key, n_email, n_ip, n_card, n_phone, base, secrets, entities, held): a row for each row of `docs`.

    `held` has the distinct terms of a text with base spans or secrets.
    """

    def run(batches):
        for batch in batches:
            texts, spans = batch["text"], _spans_of(batch["text"], bits, least)
            counts = {k: [sum(s[0] == k for s in found) for found in spans] for k in KINDS}
            written = [",".join(f"{k}:{a}:{b}" for k, a, b in found if k != "secret") for found in spans]
            secrets = [[{"start": a, "stop": b} for k, a, b in found if k == "secret"] for found in spans]
            entities, held = [[] for _ in spans], [None] * len(spans)
            rows = np.flatnonzero([bool(found) for found in spans])
            for owner, terms, starts, stops in _terms(texts.take(pa.array(rows)), [spans[i] for i in rows]):
                for i in np.unique(owner).tolist():
                    own = slice(*np.searchsorted(owner, [i, i + 1]))
                    held[rows[i]] = np.unique(terms[own]).view(np.int64)
                    entities[rows[i]] = _entities(texts[int(rows[i])].as_py(), spans[rows[i]], terms[own], starts[own], stops[own], window)
            keys = [_key(t or "") for t in values(texts)]
            arrays = [batch["doc_id"], pa.array(keys, pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(written, pa.string())]
            arrays += [pa.array(secrets, _PLACES_ARROW), pa.array(entities, pa.list_(_ONE_ARROW)), pa.array(held, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base", "secrets", "entities", "held"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, text_key bigint, {counts}, base string, secrets {_PLACES}, entities array<{_ONE}>, held array<bigint>"
    )


def _map(wanted: DataFrame) -> np.ndarray:
    """A bitmap of MAP_BITS bits of the terms in `wanted`; it lets some others through."""
    spot = F.pmod("term", F.lit(MAP_BITS))
    words = wanted.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("mask")).toArrow()
    bits = np.zeros(MAP_BITS >> 6, np.int64)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy()
    return bits.view(np.uint64)


def _in_map(bits: np.ndarray, terms: np.ndarray) -> np.ndarray:
    spot = terms & np.uint64(MAP_BITS - 1)
    return (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _term_documents(docs: DataFrame, wanted: DataFrame, known: np.ndarray, least: float) -> DataFrame:
    """(term, n_t): the number of documents that hold each wanted term."""
    bits = _map(wanted)

    def run(batches):
        for batch in batches:
            seen = []
            for owner, terms, _, _ in _terms(batch["text"], _spans_of(batch["text"], known, least)):
                hit = _in_map(bits, terms)
                terms, owner = terms[hit], owner[hit]
                order = np.lexsort((owner, terms))
                terms, owner = terms[order], owner[order]
                new = np.ones(len(terms), bool)
                new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
                seen.append(terms[new])
            terms, n = np.unique(np.concatenate([*seen, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term bigint, n bigint")
    return counted.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))


def _level_maps(fewest: DataFrame) -> list[np.ndarray]:
    """A bitmap as in `_map` of the terms of at most 4, 16, 64... texts, for each of LEVELS."""
    spot = F.pmod("term", F.lit(MAP_BITS))
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    words = fewest.select(spot.alias("spot"), "texts").groupBy(F.shiftright("spot", 6).alias("word")).agg(
        *(F.bit_or(F.when(F.col("texts") <= level, bit)).alias(f"m{i}") for i, level in enumerate(LEVELS))
    ).toArrow()
    maps = []
    for i in range(len(LEVELS)):
        bits = np.zeros(MAP_BITS >> 6, np.int64)
        bits[words["word"].to_numpy()] = words[f"m{i}"].fill_null(0).to_numpy()
        maps.append(bits.view(np.uint64))
    return maps


def _beside_pairs(each: DataFrame, fewest: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """(entity, n_e, context, copies, term): each entity of each text with the terms beside it that may disclose it.

    With n_e contexts and at most `of` texts of e, a term in more than (n_e + 1) / p(e)^(1 - threshold) + `of` texts can't
    reach the threshold, as n(t) less the texts with e is too large. So terms are dropped by bitmaps of fixed size first.
    """
    maps = _level_maps(fewest)
    holders = each.groupBy("entity").agg(F.count_distinct("context").alias("n_e"), F.count("*").alias("of"))
    rows = each.join(holders, "entity").select("entity", "n_e", "of", "context", "copies", "near")

    def run(batches):
        for batch in batches:
            kept = []
            for n_e, of, terms in zip(batch["n_e"].to_pylist(), batch["of"].to_pylist(), values(batch["near"], 100), strict=True):
                most = (n_e + 1) / (n_e / n_docs) ** (1 - threshold) + of
                level = next((m for m, top in zip(maps, LEVELS, strict=True) if top >= most), None)
                near = np.array(terms, np.int64).view(np.uint64)
                kept.append((near if level is None else near[_in_map(level, near)]).view(np.int64))
            columns = [batch[c] for c in ("entity", "n_e", "context", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.int64()))], names=["entity", "n_e", "context", "copies", "near"])

    found = rows.mapInArrow(run, "entity bigint, n_e bigint, context bigint, copies bigint, near array<bigint>")
    return found.select("entity", "n_e", "context", "copies", F.explode("near").alias("term"))


def _held_pairs(each: DataFrame, texts: DataFrame, fewest: DataFrame, n_docs: int, threshold: float, score: Column) -> DataFrame:
    """(entity, n_e, term, rows, n_te): entities and terms that share two contexts or more and may disclose by p.

    Entities of the same texts, parted into contexts alike, can't be told apart by what terms disclose them, nor can terms of the
    same texts. So classes meet instead: of entities by their texts and contexts, of terms by their texts, each told by its
    least member and by two hashes of its texts. Two texts that share 800 addresses and 4,000 words make one pair. A pair's entity stands for its class.
    """
    reps = each.groupBy("entity", "context").agg(F.min("text_key").alias("rep"))
    held_by = each.select("text_key", "copies", "entity", "context").join(reps, ["entity", "context"])
    mark = lambda salt: F.bit_xor(F.xxhash64("text_key", "rep", F.lit(salt)))
    kinds = held_by.groupBy("entity").agg(F.count_distinct("rep").alias("n_e"), F.count("*").alias("of"), mark(1).alias("e1"), mark(2).alias("e2")).where("n_e > 1")
    entities = held_by.join(kinds, "entity").groupBy("text_key", "copies", "rep", "n_e", "of", "e1", "e2").agg(F.min("entity").alias("entity"))
    entities = staged(entities.drop("e1", "e2"))
    holding = texts.join(entities.select("text_key").distinct(), "text_key", "left_semi").select("text_key", F.explode("held").alias("term"))
    terms = holding.join(fewest.where("texts > 1"), "term").groupBy("text_key", "t1", "t2", "texts", "n_t").agg(F.min("term").alias("first"))
    most = (F.col("n_e") + 1) / F.pow(F.col("n_e") / F.lit(float(n_docs)), F.lit(1 - threshold)) + F.col("of")
    met = entities.join(terms, "text_key").where(F.col("texts") <= most)
    met = met.groupBy("entity", "n_e", "first", "t1", "t2", "n_t", "rep").agg(F.sum("copies").alias("n"))
    met = met.groupBy("entity", "n_e", "first", "t1", "t2", "n_t").agg(F.sum("n").alias("rows"), F.count("*").alias("n_te")).where("n_te > 1")
    met = met.withColumn("beside", F.lit(False)).where(score >= threshold).drop("first", "n_t", "beside")
    return met.join(fewest.select("term", "t1", "t2"), ["t1", "t2"]).drop("t1", "t2")


def disclosing(docs: DataFrame, found: DataFrame, bits: np.ndarray, threshold: float = THRESHOLD, least: float = BITS) -> DataFrame:
    """(entity, term, beside, disclosure) of the terms that disclose an entity; `found` comes from `base`.

    With `beside` it is by p', in documents where the term stands beside the entity; else by p, everywhere, and
    the entity is the least of those that can't be told apart by terms. By p a
    pair in a single context discloses nothing (see above), so only terms of two texts or more are paired, and
    only pairs of more are counted on. Equal texts are taken together before anything is paired.
    """
    n_docs = found.count()
    slim = F.transform("entities", lambda e: F.struct(e.entity.alias("entity"), e.context.alias("context"), F.transform(e.near, lambda t: t.term).alias("near")))
    texts = found.where(F.size("entities") > 0).select("text_key", "held", slim.alias("entities")).groupBy("text_key")
    texts = staged(texts.agg(F.count("*").alias("copies"), F.first("held").alias("held"), F.first("entities").alias("entities")))
    mark = lambda salt: F.bit_xor(F.xxhash64("text_key", F.lit(salt)))
    fewest = texts.select("text_key", "copies", F.explode("held").alias("term")).groupBy("term")
    fewest = staged(fewest.agg(F.sum("copies").alias("n_t"), F.count("*").alias("texts"), mark(1).alias("t1"), mark(2).alias("t2")))
    each = texts.select("text_key", "copies", F.inline("entities"))
    before = F.col("n_e") / F.lit(float(n_docs))
    of = F.col("n_t") - F.col("rows") + F.col("n_te")
    after = F.when(F.col("beside"), (F.col("n_te") + before) / (of + 1)).otherwise((F.col("n_te") - 1 + before) / of)
    score = F.when(before < 1, F.log(after / before) / -F.log(before))
    beside = _beside_pairs(each, fewest, n_docs, threshold).groupBy("entity", "n_e", "term", "context").agg(F.sum("copies").alias("n"))
    beside = beside.groupBy("entity", "n_e", "term").agg(F.sum("n").alias("rows"), F.count("*").alias("n_te"))
    held = _held_pairs(each, texts, fewest, n_docs, threshold, score)
    pairs = held.withColumn("beside", F.lit(False)).unionByName(beside.withColumn("beside", F.lit(True)))
    # Disclosure falls with n(t), so pairs that fail with the documents that have spans fail with all.
    pairs = staged(pairs.join(fewest.select("term", "n_t"), "term").where(score >= threshold).drop("n_t"))
    if pairs.isEmpty():
        return pairs.select("entity", "term", "beside", F.lit(None).cast("double").alias("disclosure"))
    known = pairs.join(_term_documents(docs, staged(pairs.select("term").distinct()), bits, least), "term")
    return known.withColumn("disclosure", score).where(F.col("disclosure") >= threshold).select("entity", "term", "beside", "disclosure")


def _places(docs: DataFrame, wanted: DataFrame, known: np.ndarray, least: float) -> DataFrame:
    """(doc_id, text_key, start, stop): where wanted terms stand."""
    bits = _map(wanted)

    def run(batches):
        for batch in batches:
            texts = batch["text"]
            for owner, terms, starts, stops in _terms(texts, _spans_of(texts, known, least)):
                hit = np.flatnonzero(_in_map(bits, terms))
                rows, where = np.unique(owner[hit], return_inverse=True)
                keys = np.array([_key(texts[i].as_py()) for i in rows.tolist()], np.int64)[where]
                arrays = [batch["doc_id"].take(pa.array(owner[hit])), *(pa.array(x, pa.int64()) for x in (keys, terms[hit].view(np.int64), starts[hit], stops[hit]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "term", "start", "stop"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_key bigint, term bigint, start bigint, stop bigint")
    return seen.join(wanted, "term", "left_semi").drop("term")


def spans(docs: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, least: float = BITS) -> DataFrame:
    """`base` with added spans: its columns but entities and held, and terms, an array of (start, stop) in order."""
    bits = information(docs)
    found = staged(base(docs, bits, window, least))
    bad = staged(disclosing(docs, found, bits, threshold, least))
    out, none = found.drop("entities", "held"), F.array().cast(_PLACES)
    if bad.isEmpty():
        return out.withColumn("terms", none)
    here = found.select("doc_id", "text_key", F.explode("entities").alias("e")).select("doc_id", "text_key", "e.entity", F.explode("e.near").alias("t"))
    here = here.select("doc_id", "text_key", "entity", "t.term", "t.places").join(bad.where("beside"), ["entity", "term"], "left_semi")
    added = here.select("doc_id", "text_key", F.inline("places"))
    everywhere = staged(bad.where("NOT beside").select("term").distinct())
    if not everywhere.isEmpty():
        added = added.unionByName(_places(docs, everywhere, bits, least))
    added = added.groupBy(F.col("doc_id").alias("added_id"), F.col("text_key").alias("added_key")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("terms"))
    out = out.join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("text_key") == F.col("added_key")), "left")
    return out.drop("added_id", "added_key").withColumn("terms", F.coalesce("terms", none))


def written() -> Column:
    """All spans of a row of `spans` as one string."""
    added = lambda kind, c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"])), ",")
    return F.concat_ws(",", *(F.when(c != "", c) for c in (F.col("base"), added("secret", "secrets"), added("term", "terms"))))


def sanitised(docs: DataFrame, **parameters) -> DataFrame:
    """`docs` with each span of the text replaced by a placeholder; overlapping spans become the first one's."""
    found = spans(docs, **parameters).select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), written().alias("spans")).where("spans <> ''")
    keyed = docs.select(F.struct("*").alias("row"), "text", F.col("doc_id").alias("id"))

    def keys(batches):
        for batch in batches:
            found = [_key(t) if t else None for t in values(batch["text"])]
            yield batch.append_column("key", pa.array(found, pa.int64()))

    schema = keyed.withColumn("key", F.lit(None).cast("long")).schema
    joined = keyed.mapInArrow(keys, schema).join(
        found.dropDuplicates(["span_id", "span_key"]), F.col("id").eqNullSafe(F.col("span_id")) & (F.col("key") == F.col("span_key")), "left"
    )

    def replace(batches):
        for batch in batches:
            texts = []
            for text, marks in zip(values(batch["text"]), values(batch["spans"]), strict=True):
                parts, at = [], 0
                for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (m.split(":") for m in (marks or "").split(",") if m)):
                    if a >= at:
                        parts += [text[at:a], PLACEHOLDERS[kind]]
                        at = b
                    else:
                        at = max(at, b)
                texts.append(text if text is None else "".join([*parts, text[at:]]))
            yield batch.select(["row"]).append_column("clean", pa.array(texts, pa.string()))

    out = joined.select("row", "text", "spans").mapInArrow(replace, joined.select("row", F.lit(None).cast("string").alias("clean")).schema)
    return out.select(*(F.col("clean").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), written().alias("spans"))
