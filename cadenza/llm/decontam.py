"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, run once over each text.

Texts and items are normalised alike: A-Z lower-cased, each run of bytes that belong to no word made one space, a space at
either end. All of these bytes are ASCII, so this is a byte table and needs no decoding. A pattern is a window of WINDOW words
with its spaces (a shorter item is one window), so a match begins and ends with whole words. The automaton reads a text's
bytes once and reports each pattern that ends there; the number of spaces before gives the place among the
words, and for texts with a match the words' places in the original text come from the same byte table.

The items are the stated set that all rows meet; they are read to the driver and sent to executors as an automaton.
Their size is measured first: windows are dealt into groups of at most PATTERN_BYTES bytes, one automaton each. One
group is the common case. With more, the texts are run through one automaton after another, in blocks, each block's
marks written with the rows before the next begins, so memory stays that of one automaton however large the test
sets are. Rows are independent: nothing is shuffled but the windows. A text is read in pieces of PIECE bytes that overlap by the longest
pattern, so a task holds a batch of texts and a few copies of one of them.

Defined results: null text has no words. An item without words has no window. Rows of one item_id are one item; items of
null item_id are one, written as an empty id. Repeated documents are separate rows. Items that share a window
all count; the ids of one window's items are one row. Without items nothing is contaminated. An empty table gives an empty result. Other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import staged, table

WINDOW = 10
#: Bytes of patterns in one automaton, which takes some 90 times as much memory.
PATTERN_BYTES = 2 << 20
#: Bytes of normalised text that the automaton reads at once.
PIECE = 1 << 20

_LETTERS = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Each byte's lower case, or a space where it belongs to no word.
_FOLD = bytes(b if (b := c + 32 if 0x41 <= c <= 0x5A else c) in _LETTERS else 32 for c in range(256))


def normalised(text: bytes) -> bytes:
    """The words in lower case with one space between and at either end; one space alone without words."""
    words = b" %b " % text.translate(_FOLD)
    while b"  " in words:
        words = words.replace(b"  ", b" ")
    return words


def _windows(text: bytes, size: int) -> dict[bytes, int]:
    """The distinct windows of an item as patterns, with their number of words."""
    words = normalised(text).split()
    k = min(size, len(words))
    return {b" %b " % b" ".join(words[i : i + k]): k for i in range(len(words) - k + 1)} if words else {}


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(pattern, words, items): each distinct window and the ids of the items that have it."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if found := _windows((text or "").encode(), size):
                    patterns, words = zip(*found.items(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found)), pa.array(patterns, pa.binary()), pa.array(words, pa.int32())], ["item", "pattern", "words"])

    found = rows.mapInArrow(over, "item string, pattern binary, words int")
    return found.groupBy("pattern").agg(F.first("words").alias("words"), F.sort_array(F.collect_set("item")).alias("items"))


def _groups(found: DataFrame, most: int) -> int:
    """How many groups of about `most` bytes the windows make."""
    size = F.length("pattern") + F.aggregate("items", F.lit(0), lambda n, i: n + F.length(i))
    return max(1, -(-(found.agg(F.sum(size)).first()[0] or 0) // most))


class Automaton:
    """Over the bytes of patterns (pattern, words, items), each byte a letter."""

    def __init__(self, rows: list):
        self.found = ahocorasick.Automaton()
        for i, row in enumerate(rows):
            self.found.add_word(bytes(row[0]).decode("latin-1"), (row[1], i))
        self.found.make_automaton()
        self.items = [tuple(row[2]) for row in rows]
        self.longest = max((len(row[0]) for row in rows), default=0)

    def matches(self, words: bytes) -> Iterator[tuple[int, int, int]]:
        """(first word, last word, number of the pattern) of each occurrence in a normalised text."""
        base, begun = 0, 0  # spaces before the piece, and where it begins
        for lo in range(0, len(words) if self.items else 0, PIECE):
            start = max(0, lo - self.longest)
            base += words.count(b" ", begun, start)
            begun = start
            piece = words[start : lo + PIECE].decode("latin-1")
            spaces, at = base, 0
            for end, (n, pattern) in self.found.iter(piece):
                spaces += piece.count(" ", at, end)
                at = end
                if start + end >= lo:  # else the piece before had it
                    yield spaces - n, spaces - 1, pattern


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _places(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points of the original text, end excluded."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edge = np.diff(folded.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)])
    return [(int(starts[a] - inner[starts[a]]), int(stops[b] - inner[stops[b]])) for a, b in spans]


def _scanned(rows: DataFrame, patterns: list, last: bool) -> DataFrame:
    """`rows` (doc_id, text, and hits and items so far) with what one automaton adds; the last one lets the text go and gives the places."""
    # Each worker process holds it once; PATTERN_BYTES bounds it.
    shared = rows.sparkSession.sparkContext.broadcast(Automaton(patterns))
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    pairs = lambda spans: [{"a": a, "b": b} for a, b in spans]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, so_far = batch.column("text").cast(pa.binary()), batch.column("doc_id"), batch.column("hits")
            out: tuple[list, ...] = ([], [], [], [])
            for i in range(len(batch)):
                text = texts[i].as_py() or b""
                words = normalised(text)
                found = {*shared.value.matches(words)}
                hits = _merged([*((a, b) for a, b, _ in found), *((s["a"], s["b"]) for s in so_far[i].as_py())])
                named = {*batch.column("items")[i].as_py()}
                for pattern in {p for _, _, p in found}:
                    named.update(shared.value.items[pattern])
                for column, value in zip(out, (max(words.count(b" ") - 1, 0), pairs(hits), sorted(named), pairs(_places(text, hits)) if last and hits else []), strict=True):
                    column.append(value)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], span), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], span) if last else batch.column("text")]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_words", "hits", "items", "spans" if last else "text"])

    pair = "array<struct<a:bigint,b:bigint>>"
    return rows.mapInArrow(over, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, hits {pair}, items array<string>, {f'spans {pair}' if last else 'text string'}")


def contaminations(docs: DataFrame, items: DataFrame, size: int = WINDOW, most: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): the items found, by id, and what to cut out, as code points of the original text."""
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), none.alias("hits"), F.array().cast("array<string>").alias("items"))
    found = staged(windows(items, size))
    groups = _groups(found, most or PATTERN_BYTES)
    for i in range(groups):
        part = found if groups == 1 else found.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == i)
        rows = _scanned(rows, part.collect(), last=i == groups - 1)
        rows = rows if i == groups - 1 else staged(rows)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a + 1)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def cleaned(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """`docs` less the documents with a hit; a null doc_id, or one of several rows, goes with any of its texts that has one."""
    bad = contaminations(docs, items, size).where("n_hit > 0").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item of the benchmark."""
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
tests AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM tests WHERE len(w) > 0))),
places AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
found AS (SELECT p.r, p.i, p.k, b.item FROM places p JOIN wins b ON p.k = b.k AND p.win = b.win),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
