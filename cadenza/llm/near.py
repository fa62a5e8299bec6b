"""Near-duplicate groups: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

A document's set holds a 64-bit hash of each distinct run of five words (A-Z lower-cased); with fewer
words, of the whole sequence. Documents are linked when the Jaccard similarity of their sets is at least
3/4, and near-duplicate groups are the connected components of links.

1. One hash function gives each set its sketch: the K least hashes. Equal sets (by size and two 64-bit
   fingerprints) fall together; one document stands for each.
2. Inverted lists of retained values generate overlaps. Linked sets retain at least c(n) common values
   (all sets below 3/4 K: 3/4 of the set; others: 3/4 K less SIGMAS standard deviations, so a link is
   missed with a chance of about 1e-12). So each set enters only the lists of its m - c + 1 rarest
   retained values of m, and two linked sets must meet. Values that one set retains have no list.
3. Short lists give all their pairs. A longer list gives pairs with its pivot only: the member with the
   fewest unshared values, which in a group of edited copies is close to the text they all come from.
4. Pairs pass by size, then by the similarity estimated from the union of both sketches (with the same
   margin); only of pairs that pass the full sets are built, moved and intersected.
5. What the pivots leave: among the members of a pivot's lists, pairs that are not yet in one component
   are tested on full sets, in blocks of BLOCK by BLOCK members. Members already joined to the
   pivot aren't tested with each other, so a group of copies costs one row a copy; and no block holds
   more than BLOCK sets of a side, however many documents share a list. Before that, members of whose full
   set more than a quarter is in no other member's are left out, as no link can hold them: documents that share a
   passage and differ in the rest cost one row a value. A block gives a tree for each component, not all
   its links. Nothing is capped or dropped.
6. Components by alternating stars (graph.py).

Defined results: doc_id is an integer. Null, empty and blank texts have empty sets and are linked with nothing. Rows with a
null doc_id are linked with nothing, have a null component_id and are kept. Repeated rows fall into
one component; of rows with one doc_id all share `kept`. A doc_id that stands for several
different texts joins their groups. Texts of any length count whole; a text's set must fit a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import graph, hashing
from cadenza.llm.common import maybe_wanted, sifted, staged, table, tidied

WORDS = 5
K = 64
SIGMAS = 7
SHORT = 16
BLOCK = 512

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, WORDS + 1)], np.uint64)
_SET = ["n", "f1", "f2"]


def _margin(k: int) -> float:
    return SIGMAS * (k * 3 / 16) ** 0.5


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = hashing.buffers(texts)
    for first, last in hashing.pieces(offsets):
        part = hashing.LOWER[data[offsets[first] : offsets[last]]]
        starts, stops, words = hashing.words(part, offsets[first : last + 1] - offsets[first])
        hashes = hashing.hashes(part, starts, stops)
        runs = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
        for i, factor in enumerate(_FACTORS):
            runs += hashes[i : i + len(runs)] * factor
        runs = hashing.mixed(runs).view(np.int64)
        at = 0
        for n in words.tolist():
            if n >= WORDS:
                yield np.unique(runs[at : at + n - WORDS + 1])
            elif n:
                few = np.add.reduce(np.append(hashes[at : at + n] * _FACTORS[:n], np.uint64(n)), keepdims=True)
                yield hashing.mixed(few).view(np.int64)
            else:
                yield np.zeros(0, np.int64)
            at += n


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    if not len(found):
        return 0, 0
    other = hashing.mixed(found.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64)
    return int(np.add.reduce(found)), int(np.bitwise_xor.reduce(other))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, f1, f2, sketch) of every row."""

    def run(batches):
        for batch in batches:
            sizes, prints, kept = [], [], []
            for found in shingle_sets(batch["text"]):
                sizes.append(len(found))
                prints.append(_fingerprint(found))
                kept.append(found[:k].copy())
            f1, f2 = zip(*prints, strict=True) if prints else ((), ())
            arrays = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_SET, "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n bigint, f1 bigint, f2 bigint, sketch array<bigint>")


def _postings(sets: DataFrame, k: int) -> DataFrame:
    """(rep, n, lone, v): the lists that each set enters; lone counts its retained values that no other set retains."""
    _key = ["rep", *_SET]
    values = sets.select(*_key, F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    by_set = values.join(shared, "v").groupBy(*_key, "m").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    sure = F.ceil(F.col("n") * 3 / 4)
    least = F.when(F.col("n") * 4 < 3 * k, sure).otherwise(F.least(sure, F.lit(max(1, int(0.75 * k - _margin(k))))))
    lone = F.col("m") - F.size("vs")
    by_set = by_set.select("rep", "n", lone.alias("lone"), "vs", (F.col("m") - least + 1 - lone).cast("int").alias("slots"))
    return by_set.where("slots > 0").select("rep", "n", "lone", F.explode(F.slice("vs", F.lit(1), F.col("slots"))["v"]).alias("v"))


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, values): the full sets of the documents that entered a list."""
    near = maybe_wanted(docs.select("doc_id", "text"), "doc_id", wanted.select("rep"))
    texts = near.join(wanted, F.col("doc_id") == F.col("rep")).select("rep", *_SET, "text")

    def run(batches):
        for batch in batches:
            known = list(zip(*(batch[c].to_pylist() for c in _SET), strict=True))
            found = [(i, s) for i, s in enumerate(shingle_sets(batch["text"])) if (len(s), *_fingerprint(s)) == known[i]]
            rows = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["rep"].take(rows), _lists([s for _, s in found])], names=["rep", "values"])

    return texts.mapInArrow(tidied(run), "rep bigint, values array<bigint>")


def _likely(pairs: DataFrame, retained: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) that may be links by the union-sketch estimate. Only sketches move."""
    side = lambda r, s, m: retained.select(F.col("rep").alias(r), F.col("sketch").alias(s), F.col("n").alias(m))
    low = F.slice(F.array_sort(F.array_union("av", "bv")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("av", "bv"), low))
    likely = shared >= F.when((F.col("an") <= k) & (F.col("bn") <= k), F.lit(0)).otherwise(F.lit(0.75) * F.size(low) - F.lit(_margin(k)))
    return pairs.join(side("a", "av", "an"), "a").join(side("b", "bv", "bn"), "b").where(likely).select("a", "b").distinct()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, on the full sets."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("values").alias("av")), sets.select(F.col("rep").alias("b"), F.col("values").alias("bv"))
    common = F.size(F.array_intersect("av", "bv"))
    return pairs.join(left, "a").join(right, "b").where(4 * common >= 3 * (F.size("av") + F.size("bv") - common)).select("a", "b")


def _close_sizes(a: str, b: str):
    return F.expr(f"4 * least({a}, {b}) >= 3 * greatest({a}, {b})")


def _block_links(one: pa.Table) -> pa.Table:
    """Edges that join what links join between the left and the right members of a block; members of one component aren't compared."""
    left, right = (one.filter(pc.equal(one["side"], s)) for s in (0, 1))
    sides = []
    for side in (left, right):
        arrays = [v.values.to_numpy(zero_copy_only=False) for v in side["values"]]
        sides.append((np.array(side["x"].to_pylist(), np.int64), np.array(side["label"].to_pylist(), np.int64), arrays, np.array([len(a) for a in arrays])))
    (xa, la, va, na), (xb, lb, vb, nb) = sides
    if not len(xa) or not len(xb):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    fa, fb = np.concatenate(va), np.concatenate(vb)
    shared = np.intersect1d(fa, fb)
    common = np.zeros((len(xa), len(xb)), np.float32)
    places = []
    for flat, sizes in ((fa, na), (fb, nb)):
        col = np.searchsorted(shared, flat)
        col[col == len(shared)] = 0
        hit = shared[col] == flat if len(shared) else np.zeros(len(flat), bool)
        places.append((np.repeat(np.arange(len(sizes)), sizes)[hit], col[hit]))
    for lo in range(0, len(shared), 4096):
        dense = []
        for (row, col), n in zip(places, (len(xa), len(xb)), strict=True):
            m = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
            inside = (col >= lo) & (col < lo + 4096)
            m[row[inside], col[inside] - lo] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    linked = (4 * common >= 3 * (na[:, None] + nb[None, :] - common)) & (la[:, None] != lb[None, :])
    ends: list[np.ndarray] = [np.zeros(0, np.int64)]
    starts: list[np.ndarray] = [np.zeros(0, np.int64)]
    rows, cols = ~linked.any(1), np.zeros(len(xb), bool)  # those done
    for root in range(len(xa)):  # a tree for each component, not all its links
        reached = np.array([root])
        while len(reached) and not rows[reached].all():
            rows[reached] = True
            new = linked[reached].any(0) & ~cols
            cols |= new
            more = np.flatnonzero(linked[:, new].any(1) & ~rows)
            found = np.concatenate([xb[new], xa[more]])
            ends.append(found)
            starts.append(np.full(len(found), xa[root]))
            reached = more
    return pa.table({"a": pa.array(np.concatenate(starts)), "b": pa.array(np.concatenate(ends))})


def _unlinked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members x that can't be linked with another: more than a quarter of the full set is in no other member's."""
    rows = members.select("x").distinct().join(sets.select(F.col("rep").alias("x"), "values"), "x")
    alone = rows.select("x", F.size("values").alias("n"), F.explode("values").alias("v")).groupBy("v").agg(F.count("*").alias("df"), F.min(F.struct("x", "n")).alias("o"))
    lone = alone.where("df = 1").groupBy("o.x").agg(F.count("*").alias("lone"), F.max("o.n").alias("n"))
    return lone.where(F.col("lone") > F.col("n") - F.ceil(F.col("n") * 3 / 4)).select("x")


def _dense_links(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the members (p, x) of each pivot p's lists that the components so far don't join.

    Left are the members outside the pivot's component, right all members; those that can't be linked are left out before.
    """
    named = members.join(labels.select(F.col("vertex").alias("x"), F.col("component").alias("cx")), "x", "left").join(
        labels.select(F.col("vertex").alias("p"), F.col("component").alias("cp")), "p", "left"
    )
    named = staged(named.select("p", "x", F.coalesce("cx", "x").alias("label"), (F.coalesce("cx", "x") != F.coalesce("cp", "p")).alias("outside")))
    counts = named.groupBy("p").agg(F.count("*").alias("all"), F.count_if("outside").alias("out")).where("out > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    named = named.join(counts.select("p"), "p", "left_semi")
    named = staged(named.join(_unlinked(named, sets), "x", "left_anti"))
    counts = named.groupBy("p").agg(F.count("*").alias("all"), F.count_if("outside").alias("out")).where("out > 0")
    named = named.join(staged(counts.select("p", blocks("all").alias("rights"), blocks("out").alias("lefts"))), "p")
    own = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = named.where("outside").select("p", "x", "label", F.lit(0).alias("side"), own("lefts").alias("l"), every("rights").alias("r"))
    right = named.select("p", "x", "label", F.lit(1).alias("side"), every("lefts").alias("l"), own("rights").alias("r"))
    rows = left.unionByName(right).join(sets.select(F.col("rep").alias("x"), "values"), "x")
    return rows.groupBy("p", "l", "r").applyInArrow(_block_links, "a bigint, b bigint")


def groups(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of `docs`."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(sketches(docs, k))
    sets = staged(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*_SET).agg(F.min("doc_id").alias("rep")))
    held = rows.select("doc_id", *_SET).join(sets, _SET).select("doc_id", "rep").distinct()
    several = held.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    shared_ids = staged(held.join(several, "doc_id").select("a", F.col("rep").alias("b")))  # an id with several texts joins their groups
    retained = rows.join(sets.withColumnRenamed("rep", "doc_id"), [*_SET, "doc_id"]).select(F.col("doc_id").alias("rep"), *_SET, "sketch")
    retained = staged(retained.dropDuplicates(["rep", *_SET]))
    posted = staged(_postings(retained, k))
    lists = posted.groupBy("v").agg(F.count("*").alias("size"), F.min(F.struct("lone", "rep", "n")).alias("pivot")).where("size > 1")
    lists = staged(lists.select("v", "size", F.col("pivot.rep").alias("p"), F.col("pivot.n").alias("pn")))
    listed = posted.join(lists, "v")
    short = listed.where(F.col("size") <= SHORT).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("xs"))
    later = F.transform("xs", lambda x, i: F.transform(F.filter(F.slice("xs", i + 2, F.lit(SHORT)), lambda y: F.least(x.n, y.n) * 4 >= F.greatest(x.n, y.n) * 3), lambda y: F.struct(x.rep.alias("a"), y.rep.alias("b"))))
    short = short.select(F.explode(F.flatten(later)).alias("ab")).select("ab.a", "ab.b")
    members = staged(listed.where(F.col("size") > SHORT).select("p", "pn", F.col("rep").alias("x"), "n").distinct())
    stars = members.where("p <> x").where(_close_sizes("pn", "n")).select(F.least("p", "x").alias("a"), F.greatest("p", "x").alias("b"))
    likely = staged(_likely(short.unionByName(stars).distinct(), retained, k))
    compared = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).unionByName(members.select(F.col("x").alias("rep"))).distinct()
    full = staged(_full_sets(docs, staged(compared.join(sets, "rep"))))
    links = staged(_links(likely, full).unionByName(shared_ids))
    found = staged(graph.components(links))
    more = staged(_dense_links(members.select("p", "x").distinct(), found, full))
    if not more.isEmpty():
        found = graph.components(links.unionByName(more))
    named = sets.join(found, sets.rep == found.vertex, "left").select(*_SET, F.coalesce("component", "rep").alias("group_id"))
    own = F.col("doc_id")
    out = rows.join(named, _SET, "left").withColumn("component_id", F.when(own.isNotNull(), F.coalesce("group_id", own)))
    return out.select(
        own.cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"),
        F.coalesce(own == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one document of each group, with all their columns. Only rows that may go are shuffled."""
    gone = staged(groups(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return sifted(rows, "id", gone, lambda some: some.join(gone, F.col("id") == F.col("gone_id"), "left_anti")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
