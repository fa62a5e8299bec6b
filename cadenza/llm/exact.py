"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

A text (null counts as empty) is normalised by turning each run of white space into one space, in
UTF-8. It is cut into chunks of CHUNK bytes; each has a polynomial hash modulo a prime, for two bases:

    h(c) = c[0] + c[1] B + c[2] B^2 + ...      h(ab) = h(a) + B^|a| h(b)

Chunks are hashed apart, and Spark folds a text's chunk hashes by the length-shifted sum above.
Rows with equal (length, fingerprint) form a group. The texts of a group are compared chunk by chunk:
for each index the least and the greatest version are kept while chunks stream by, on both sides of the
shuffle, so copies meet before they are sent and no task holds a group or a whole text of one. A group
with two versions of a chunk, which a collision alone can cause, is told apart by SHA-256 as well; so
the result never rests on the fingerprint.

Only rows of groups of two or more are read again for the comparison; a fixed-size bitmap of their
ids drops the others.

Defined results: the row with the smallest doc_id stays, a null doc_id counting as the largest. Of
repeated rows with one doc_id and equal text one stays. Empty, null and blank texts: null and empty
are equal; blank ones equal " ". An empty table gives an empty result. Columns beside doc_id and
text pass through `deduplicate` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm import hashing
from cadenza.llm.common import SPACE, maybe_wanted, sifted, staged, table, tidied

CHUNK = 1 << 16
PRIME = (1 << 31) - 1
BASES = (1_000_003_579, 1_500_450_271)

_CHUNKS = "array<struct<h1:bigint,h2:bigint,s1:bigint,s2:bigint>>"
_CHUNKS_ARROW = pa.list_(pa.struct([(k, pa.int64()) for k in ("h1", "h2", "s1", "s2")]))


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of `base` modulo PRIME, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), PRIME))
        out = np.concatenate([out, out * step % np.uint64(PRIME)])
    return out[:n]


def _hasher(bases: tuple[int, int], chunk: int):
    """(data, bounds) -> for each text its chunks' hashes and shifts."""
    tables: dict = {}

    def hashed(data: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
        length = np.diff(bounds)
        count = -(-length // chunk)
        owner = np.repeat(np.arange(len(length)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = bounds[:-1][owner] + nth * chunk
        stop = np.minimum(start + chunk, bounds[1:][owner])
        cols = []
        for base in bases:
            if (base, "up") not in tables or len(tables[base, "up"]) < chunk + 1:
                tables[base, "up"] = _powers(base, chunk + 1)
            up = tables[base, "up"]
            h = np.zeros(len(start), np.uint64)
            # A window of at most 2^24 bytes keeps the sums below 2^64.
            local = np.arange(len(data)) - np.repeat(start, stop - start)
            terms = data * up[local] if len(data) else np.zeros(0, np.uint64)
            if len(start):
                h = np.add.reduceat(terms, start) % np.uint64(PRIME)
            cols += [h, up[stop - start]]
        rows = list(zip(*(c.tolist() for c in cols), strict=True))
        out: list[list[dict]] = [[] for _ in length]
        for i, (h1, s1, h2, s2) in zip(owner.tolist(), rows, strict=True):
            out[i].append({"h1": h1, "h2": h2, "s1": s1, "s2": s2})
        return out

    return hashed


def _normalised(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = hashing.buffers(texts)
    for first, last in hashing.pieces(offsets):
        yield first, last, *hashing.squeezed(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def fingerprints(docs: DataFrame, bases: tuple[int, int] = BASES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, h1, h2, sha): the fingerprint of each row's normalised text."""

    def run(batches):
        hashed = _hasher(bases, chunk)
        for batch in batches:
            chunks, sizes, shas = [], [], []
            for _, _, data, bounds in _normalised(batch["text"]):
                chunks += hashed(data, bounds)
                sizes += np.diff(bounds).tolist()
                view = memoryview(data)
                shas += [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(chunks, _CHUNKS_ARROW), pa.array(shas, pa.string())],
                names=["doc_id", "n_bytes", "chunks", "sha"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_bytes bigint, chunks {_CHUNKS}, sha string")
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(long(0).alias("h1"), long(0).alias("h2"), long(1).alias("s1"), long(1).alias("s2"))
    fold = F.aggregate(
        "chunks", start,
        lambda a, c: F.struct(
            ((a.h1 + a.s1 * c.h1) % PRIME).alias("h1"), ((a.h2 + a.s2 * c.h2) % PRIME).alias("h2"),
            (a.s1 * c.s1 % PRIME).alias("s1"), (a.s2 * c.s2 % PRIME).alias("s2"),
        ),
    )
    return parts.withColumn("f", fold).select("doc_id", "n_bytes", "f.h1", "f.h2", "sha")


_KEY = ["n_bytes", "h1", "h2"]


def _folded(chunks: list[dict]) -> tuple[int, int]:
    """The same fold for one text."""
    h1 = h2 = 0
    s1 = s2 = 1
    for c in chunks:
        h1, h2 = (h1 + s1 * c["h1"]) % PRIME, (h2 + s2 * c["h2"]) % PRIME
        s1, s2 = s1 * c["s1"] % PRIME, s2 * c["s2"] % PRIME
    return h1, h2


def _broken(docs: DataFrame, members: DataFrame, bases: tuple[int, int], chunk: int) -> DataFrame:
    """The keys of groups whose texts are not all equal: some chunk has a least and a greatest version that differ."""

    def run(batches):
        hashed = _hasher(bases, chunk)
        for batch in batches:
            rows = []
            for _, _, data, bounds in _normalised(batch["text"]):
                view = memoryview(data)
                for found, a, b in zip(hashed(data, bounds), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    h1, h2 = _folded(found)
                    rows += [(b - a, h1, h2, k, bytes(view[at : min(at + chunk, b)])) for k, at in enumerate(range(a, b, chunk))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=[*_KEY, "nth", "part"])

    wanted = maybe_wanted(docs.select("doc_id", "text"), "doc_id", members)
    chunks = wanted.select("text").mapInArrow(tidied(run), "n_bytes bigint, h1 bigint, h2 bigint, nth bigint, part binary")
    versions = chunks.groupBy(*_KEY, "nth").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    return versions.where("a <> b").select(*_KEY).distinct()


def classes(docs: DataFrame, bases: tuple[int, int] = BASES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of `docs`."""
    rows = staged(fingerprints(docs, bases, chunk))
    groups = staged(rows.groupBy(*_KEY).agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id")).where("group_size > 1"))
    broken = staged(_broken(docs, rows.join(groups, _KEY).select("doc_id"), bases, chunk))
    # Numbering repeated rows of a doc_id needs no more than those rows together; done first, it is dealt by all its keys.
    copy = F.row_number().over(Window.partitionBy(*_KEY, "sha", "doc_id").orderBy("sha"))
    rows = rows.withColumn("copy", copy)
    keys = _KEY
    if not broken.isEmpty():  # only a collision makes these; their rows are told apart by SHA-256 as well
        rows = rows.join(broken.withColumn("is_broken", F.lit(True)), _KEY, "left").withColumn("part", F.when(F.col("is_broken"), F.col("sha")).otherwise(""))
        keys = [*_KEY, "part"]
        groups = staged(rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id")).where("group_size > 1"))
    found = rows.join(groups, keys, "left")  # a text without a second row is in no group
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Only rows of texts with copies are shuffled."""
    copies = classes(docs).where("group_size > 1").groupBy(F.col("doc_id").alias("copy_id"), F.col("text_sha256").alias("copy_sha"))
    copies = staged(copies.agg(F.max("kept").alias("stays")))

    def rule(rows: DataFrame) -> DataFrame:
        text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
        rows = rows.withColumn("sha", F.sha2(text.cast("binary"), 256))
        rows = rows.join(copies, F.col("id").eqNullSafe(F.col("copy_id")) & (F.col("sha") == F.col("copy_sha")), "left")
        first = F.row_number().over(Window.partitionBy("id", "sha").orderBy("sha")) == 1
        return rows.withColumn("first", first).where("stays IS NULL OR (stays AND first)").select("row", "id", "text")

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text")
    return sifted(rows, "id", copies, rule).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY t, doc_id) AS copy, min(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size FROM docs)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(t) AS text_sha256 FROM numbered
"""
