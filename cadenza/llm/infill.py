"""Fill-in-the-middle: each text cut at two unit boundaries and written as prefix, suffix, middle with sentinels between.

A byte automaton given by a table reads UTF-8: its states tell white space from words and how far a sentinel has come, its
transitions are marked where a code point starts, where a unit ends and where a sentinel is complete. Any three
bytes fix its state (checked when the table is made), so the table composed over three byte classes gives
the states of a whole block at once. The first pass scans each block once and keeps counts of marked transitions only;
the number of units is their sum. The second pass goes back to the blocks whose counts hold a cut, and finds its place there.

A unit is white space and the word after it; white space at the end of a text is a unit of its own. The draws come from a
hash of the seed and doc_id alone, so reruns and other partitionings agree. Rows are independent: no shuffle. A task holds
one Arrow batch of texts, their outputs, and arrays over one block of BLOCK bytes.

Defined results: null text is empty. Empty texts, texts that hold a sentinel, and those that the draw leaves alone are
plain: the output is the text, prefix_chars and middle_chars are null. Prefix, middle and suffix can each be empty. A null
doc_id draws as an empty one. Repeated rows and repeated ids get equal draws. Texts of any length are cut whole. An
empty table gives an empty result. Other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of the texts that are cut, and percent of these that start with the suffix.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes that are scanned at once.
BLOCK = 1 << 20

# Byte classes, states and marks of transitions.
_END, _SPACE, _INNER, _OPEN, _NAME, _CLOSE, _OTHER = range(7)
_START, _BLANK, _WORD, _OPENED, _NAMED, _COMPLETE = range(6)
_POINT, _UNIT, _SENTINEL = 1, 2, 4
#: Stands between texts; no byte of UTF-8 has this value.
_BETWEEN = b"\xff"


def _classes() -> np.ndarray:
    of = np.full(256, _OTHER, np.uint8)
    of[[9, 10, 11, 12, 13, 32]] = _SPACE
    of[0x80:0xC0] = _INNER
    of[ord("<")], of[ord(">")], of[_BETWEEN[0]] = _OPEN, _CLOSE, _END
    of[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = _NAME
    return of


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next state and the marks by (state, class), and the state after any three classes."""
    states, classes = 6, 7
    to = np.full((states, classes), _WORD, np.uint8)
    to[:, _END], to[:, _SPACE], to[:, _OPEN] = _START, _BLANK, _OPENED
    to[_OPENED, _NAME], to[_NAMED, _CLOSE] = _NAMED, _COMPLETE
    marks = np.zeros((states, classes), np.uint8)
    marks[:, [c for c in range(classes) if c not in (_END, _INNER)]] |= _POINT
    marks[_WORD:, [_END, _SPACE]] |= _UNIT
    marks[_BLANK, _END] |= _UNIT
    marks[_NAMED, _CLOSE] |= _SENTINEL
    after = np.zeros(classes**3, np.uint8)
    for i, (a, b, c) in enumerate(product(range(classes), repeat=3)):
        ends = {int(to[to[to[s, a], b], c]) for s in range(states)}
        assert len(ends) == 1, "three bytes must fix the state"
        after[i] = ends.pop()
    return to, marks, after


_CLASS = _classes()
_TO, _MARKS, _AFTER = _tables()


def _marked(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The marks of the transitions over data[lo:hi]. data[0] stands between texts, so what comes before it doesn't matter."""
    of = _CLASS[data[max(lo - 3, 0) : hi]]
    of = np.concatenate([np.full(3 - min(lo, 3), _END, np.uint8), of]).astype(np.int16)
    state = _AFTER[(of[:-3] * 7 + of[1:-2]) * 7 + of[2:-1]]
    return _MARKS.reshape(-1)[state * np.uint8(7) + of[3:].astype(np.uint8)]


def _counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First pass: where the counted spans start, and (points, units, sentinels) of each; spans end at texts and at blocks."""
    edges = np.unique(np.concatenate([bounds, np.arange(0, len(data), BLOCK), [len(data)]]))
    found = np.zeros((len(edges) - 1, 3), np.int64)
    for lo in range(0, len(data), BLOCK):
        hi = min(lo + BLOCK, len(data))
        marks = _marked(data, lo, hi)
        a, b = np.searchsorted(edges, [lo, hi])
        at = edges[a:b] - lo
        for i, bit in enumerate((_POINT, _UNIT, _SENTINEL)):
            found[a:b, i] = np.add.reduceat((marks & bit) > 0, at, dtype=np.int64)
    return edges, found


def _cut(data: np.ndarray, edges: np.ndarray, upto: np.ndarray, first: int, units: int) -> tuple[int, int]:
    """Second pass: (byte, code points) after `units` units of the text whose spans start with number `first`."""
    if not units:
        return int(edges[first]), 0
    span = int(np.searchsorted(upto[:, 1], upto[first, 1] + units, "left")) - 1
    marks = _marked(data, int(edges[span]), int(edges[span + 1]))
    place = int(np.flatnonzero(marks & _UNIT)[upto[first, 1] + units - upto[span, 1] - 1])
    points = upto[span, 0] - upto[first, 0] + np.count_nonzero(marks[:place] & _POINT)
    return int(edges[span]) + place, int(points)


def _draws(doc_id: str | None, seed: int) -> list[int]:
    digest = sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


def _transformed(ids: list[str | None], texts: list[bytes | None], seed: int, rate: int, suffix_first: int) -> Iterator[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    texts = [t or b"" for t in texts]
    joined = _BETWEEN + _BETWEEN.join(texts) + _BETWEEN
    data = np.frombuffer(joined, np.uint8)
    # A text's spans start at its first byte and end with the byte after it, which closes its last unit.
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    edges, found = _counts(data, starts)
    upto = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(found, axis=0)])
    spans = np.searchsorted(edges, starts)
    for doc_id, text, start, (a, b) in zip(ids, texts, starts, pairwise(spans), strict=False):
        _, n, sentinels = (upto[b] - upto[a]).tolist()
        h1, h2, h3, h4 = _draws(doc_id, seed)
        if not text or sentinels or h3 % 100 >= rate:
            yield n, "plain", None, None, text
            continue
        less, more = sorted((h1 % (n + 1), h2 % (n + 1)))
        (i, before), (j, upto_j) = (_cut(data, edges, upto, int(a), u) for u in (less, more))
        prefix, middle, suffix = text[: i - start], text[i - start : j - start], text[j - start :]
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        if h4 % 100 < suffix_first:
            yield n, "spm", before, upto_j - before, b"".join((s, suffix, p, prefix, m, middle))
        else:
            yield n, "psm", before, upto_j - before, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text plain, or as psm or spm."""
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("drawn_by"), F.col("text").cast("string").alias("text"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("drawn_by"), batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            parts = np.cumsum(sizes) // (4 * BLOCK)  # groups of some blocks; a longer text is alone or the last of its group
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)] if len(texts) else [0]
            for a, b in pairwise(edges):
                found = [*_transformed(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), seed, rate, suffix_first)]
                n, form, prefix, middle, output = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(over, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text from what `transform` made of it. No part holds a sentinel, so the first of each is the one written."""
    at = lambda mark: F.locate(mark, output)
    between = lambda a, b: F.substring(output, at(a) + 3, at(b) - at(a) - 3)
    after = F.substring(output, at(MIDDLE) + 3, F.char_length(output))
    whole = F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE)))
    return whole.when(form == "spm", F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text rebuilt from it."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return transform(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM units),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM formed),
written AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM written
"""
