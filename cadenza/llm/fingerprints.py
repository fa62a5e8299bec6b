"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A document's paragraphs are its distinct non-empty lines, cut further after each sentence end, so a long line
changes in part as well; each has a 64-bit digest. A sketch of m cells
in three parts of m/3 adds every digest to one cell of each part; a cell holds a count, the XOR of its
digests and the XOR of their checksums. Sketches are linear: the cells of one version less those of
another hold only the paragraphs in which they differ. Peeling takes out digests from cells that hold
a single one until nothing is left, which recovers the two sides of the difference; where it gets stuck,
it is tried again with a sketch GROWTH times as large, until all
succeed. The first size comes from the two counts and from how far the SAMPLE least digests of both agree.
A document's fingerprint is its sketch of CELLS cells. The likeness of two sketches is the Jaccard
similarity of the two sets of paragraphs, from their sizes and the peeled difference.

Digests are dealt into blocks of about BLOCK that differ, by their hash; each has a sketch of its own, so peeling costs the number
of digests times a constant, and only blocks that are stuck are tried again. A cell is a row, keyed by its pair of documents, block and place.
The signed digests of both sides are exploded and summed by a
generated aggregate, which is the difference of the two sketches. A block's cells that aren't empty then meet in one array, of some 60 at first, and a round
of peeling goes over what is left of it. Rows are dealt by pair once in each pass; the driver reads only whether any block is stuck.

Finding each document's successor in descending doc_id deals rows into ranges of doc_id by approximate quantiles (as many
bounds as ranges, read by the driver), as many ranges to each partition; rows are ordered inside each range, and the first row of every range also closes the range
before it. An id that makes a range of its own, and null, are split further by the hash of the text, which also orders
their rows. One shuffle moves the texts; later ones only digests. Only the ranges' numbers meet in one window.

Defined results: doc_id is a number; another type is refused. Null text is empty. A document's list of digests must fit a row. Documents without paragraphs are alike (1.0), and unlike any
other (0.0). Ties of doc_id are ordered by their texts; a null doc_id comes last. A single document is
its own successor. Repeated rows are separate documents. An empty table gives an empty result. Columns
beside doc_id and text don't take part. The search runs its passes when it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import maybe_wanted, partitions, staged, table

CELLS = 12
SAMPLE = 16
#: Differing digests that a block is made for.
BLOCK = 24
#: Cells for each digest that is expected to differ; peeling needs 1.23 at large sizes, and more in small blocks.
SPACE = 2.0
#: How much larger a sketch is that is tried again.
GROWTH = 3
#: Peeling takes a number of rounds that grows with the logarithm of the logarithm of a size it can do at all.
ROUNDS = 24
#: Paragraphs end at line ends and at white space after one of these marks, or right after a full-width one.
PARAGRAPH = r"\n|(?<=[.!?;:。！？])[ \t]+|(?<=[。！？])"
#: Ranges of doc_id for each shuffle partition, so that partitions get about equally much.
RANGES = 4

_CELL = ["id", "width", "block", "at"]


def _long(x) -> Column:
    return F.lit(x).cast("long")


def paragraphs(text: Column) -> Column:
    """The digests of the distinct paragraphs."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(digest: Column, width: Column) -> list[Column]:
    """The cells of a digest, one in each part of `width` cells."""
    return [F.pmod(F.xxhash64(digest, F.lit(part)), width) + width * part for part in range(3)]


def cells(entries: DataFrame) -> DataFrame:
    """The sketches of signed digests (id, width, block, n, k), one row for each cell that isn't empty: id, width, block, at, n, k, c."""
    placed = entries.select("*", _check(F.col("k")).alias("c"), F.explode(F.array(*_places(F.col("k"), F.col("width")))).alias("at"))
    total = placed.groupBy(*_CELL).agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return total.where((F.col("n") != 0) | (F.col("k") != 0) | (F.col("c") != 0))


def peeled(left: Column, width: Column) -> Column:
    """(left, only_a, only_b) of the cells (at, n, k, c) of a difference: what stays stuck, and the digests of either side."""

    def without(cell: Column, pure: Column) -> Column:
        less = lambda a, e: F.struct(a["at"].alias("at"), (a.n - e.n).alias("n"), a.k.bitwiseXOR(e.k).alias("k"), a.c.bitwiseXOR(e.c).alias("c"))
        hit = lambda a, e: F.array_contains(e.places, a["at"])
        return F.aggregate(pure, cell, lambda a, e: F.when(hit(a, e), less(a, e)).otherwise(a))

    def taken(state: Column, pure: Column) -> Column:
        side = lambda sign: F.transform(F.filter(pure, lambda e: e.n == sign), lambda e: e.k)
        rest = F.filter(F.transform(state.left, lambda cell: without(cell, pure)), lambda c: (c.n != 0) | (c.k != 0) | (c.c != 0))
        return F.struct(rest.alias("left"), F.concat(state.only_a, side(1)).alias("only_a"), F.concat(state.only_b, side(-1)).alias("only_b"))

    def once(state: Column, _: Column) -> Column:
        single = F.filter(state.left, lambda c: (F.abs(c.n) == 1) & (_check(c.k) == c.c))
        entry = lambda c: F.struct(c.n.alias("n"), c.k.alias("k"), c.c.alias("c"), F.array(*_places(c.k, width)).alias("places"))
        return _let(F.array_distinct(F.transform(single, entry)), lambda pure: F.when(F.size(pure) == 0, state).otherwise(taken(state, pure)))

    none = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("left"), none.alias("only_a"), none.alias("only_b")), once)


def first_size(a: Column, b: Column) -> Column:
    """(blocks, width) that the difference needs by the counts and by the agreement of the least digests."""
    least = lambda x: F.slice(F.sort_array(x), 1, SAMPLE)
    count = lambda x: F.size(x).cast("double")

    def needed(s: Column) -> Column:
        union = F.slice(F.sort_array(F.array_union(s.a, s.b)), 1, SAMPLE)
        alike = F.size(F.array_intersect(F.array_intersect(s.a, s.b), union)) / F.greatest(F.size(union), F.lit(1))
        return F.greatest(F.abs(count(a) - count(b)), (count(a) + count(b)) * (1 - alike) / (1 + alike))

    def size(differ: Column) -> Column:
        blocks = F.greatest(_long(1), F.ceil(differ / BLOCK))
        return F.struct(blocks.alias("blocks"), F.greatest(_long(CELLS // 3), F.ceil(differ / blocks * SPACE / 3) + 2).cast("long").alias("width"))

    return _let(F.struct(least(a).alias("a"), least(b).alias("b")), lambda s: _let(needed(s), size))


def tried(pairs: DataFrame, listed: bool = True) -> DataFrame:
    """One pass over pairs (id, a, b, blocks, width, only): (id, stuck, only_a, only_b); `only` lists the blocks to try, null for all.

    The digests that differ, or their numbers, are those of the blocks that succeed; stuck lists the others. A pair that doesn't differ has no row.
    """
    sides = F.array(F.struct(_long(1).alias("n"), F.col("a").alias("ks")), F.struct(_long(-1).alias("n"), F.col("b").alias("ks")))
    dealt = pairs.repartition(partitions(pairs.sparkSession), "id").select("id", "width", "blocks", "only", F.inline(sides))
    entries = dealt.select("id", "width", "blocks", "only", "n", F.explode("ks").alias("k")).withColumn("block", F.pmod(F.xxhash64("k", F.lit("block")), F.col("blocks")))
    entries = entries.where(F.col("only").isNull() | F.array_contains("only", F.col("block"))).select("id", "width", "block", "n", "k")
    held = cells(entries).groupBy("id", "width", "block").agg(F.collect_list(F.struct("at", "n", "k", "c")).alias("left"))
    found = held.select("id", "block", peeled(F.col("left"), F.col("width")).alias("s")).select("id", "block", (F.size("s.left") > 0).alias("bad"), "s.only_a", "s.only_b")
    kept = lambda side: F.when(~F.col("bad"), F.col(side))
    total = lambda side: F.flatten(F.collect_list(kept(side))) if listed else F.coalesce(F.sum(F.size(kept(side))), _long(0))
    return found.groupBy("id").agg(F.collect_list(F.when(F.col("bad"), F.col("block"))).alias("stuck"), *(total(side).alias(side) for side in ["only_a", "only_b"]))


def difference(pairs: DataFrame, listed: bool = True) -> DataFrame:
    """(id, only_a, only_b): the digests in which the lists a and b of each id differ, or their numbers, by sketches whose stuck blocks grow until peeling succeeds.

    The ids are distinct; pairs that don't differ have no row.
    """
    pairs, only = pairs.select("id", "a", "b"), F.lit(None).cast("array<bigint>").alias("only")
    sized = lambda df: df.select("*", first_size(F.col("a"), F.col("b")).alias("size")).select("id", "a", "b", "only", "size.*")
    todo, out, growth = sized(pairs.select("*", only)), None, 1
    while True:
        found = staged(tried(todo, listed))
        out = found if out is None else out.unionByName(found)
        stuck = found.where(F.size("stuck") > 0).select("id", F.col("stuck").alias("only"))
        if stuck.isEmpty():
            break
        growth *= GROWTH
        todo = sized(maybe_wanted(pairs, "id", stuck).join(stuck, "id")).withColumn("width", F.col("width") * growth)
    total = lambda side: F.flatten(F.collect_list(side)) if listed else F.sum(side)
    return out.groupBy("id").agg(*(total(side).alias(side) for side in ["only_a", "only_b"]))


def likeness(pairs: DataFrame) -> DataFrame:
    """(id, likeness): the Jaccard similarity of two lists of distinct digests, by their sketches."""
    sizes = pairs.select("id", F.size("a").alias("na"), F.size("b").alias("nb"))
    both = sizes.join(difference(pairs, listed=False), "id", "left")
    similar = (F.col("na") - F.col("only_a")) / (F.col("na") + F.col("only_b"))
    return both.select("id", F.coalesce(similar, F.lit(1.0)).alias("likeness"))


def fingerprint(lists: DataFrame) -> DataFrame:
    """(id, fingerprint): the sketch of CELLS cells of each list of digests (id, digests) as text: the number of paragraphs, then each cell in hexadecimal."""
    hexed = lambda x: F.lpad(F.hex(x), 16, "0")
    width = CELLS // 3
    dealt = lists.repartition(partitions(lists.sparkSession), "id")
    held = cells(dealt.select("id", _long(width).alias("width"), _long(0).alias("block"), _long(1).alias("n"), F.explode("digests").alias("k")))
    entry = F.struct("at", F.concat(F.hex("n"), F.lit("."), hexed("k"), hexed("c")).alias("text"))
    # One list of CELLS entries at most for each document; a digest is in one cell of the first part, so that part's counts make the number.
    rows = held.groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("cells"), F.sum(F.when(F.col("at") < width, F.col("n"))).alias("size"))
    return rows.select("id", _written(F.col("size"), F.col("cells"), width).alias("fingerprint"))


def _written(size: Column, held: Column, width: int) -> Column:
    each = F.transform(F.sequence(_long(0), _long(3 * width - 1)), lambda j: F.coalesce(F.element_at(held, j), F.lit("0." + "0" * 32)))
    return F.lower(F.concat_ws(":", size.cast("string"), F.array_join(each, ":")))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digests, next_text, next_digests): each document and the next in descending doc_id, the first after the last."""
    if not isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        raise TypeError("doc_id must be a number")
    many = partitions(docs.sparkSession)
    ranges = many * RANGES
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = (docs.agg(F.percentile_approx("doc_id", shares, 100 * ranges)).first()[0] if shares else None) or []
    listed = lambda xs: F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<bigint>")
    hot = listed(sorted({b for b in bounds if bounds.count(b) > 1}))
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(listed(sorted({*bounds})), lambda b: b < F.col("doc_id"))))
    split = F.when(F.col("doc_id").isNull() | F.array_contains(hot, F.col("doc_id")), F.shiftright(F.col("h"), 56) + 129).otherwise(F.lit(0))
    kept = F.struct("text", paragraphs(F.col("text")).alias("digests"))
    rows = docs.withColumn("h", F.xxhash64("text")).select(
        (at.cast("long") * 1024 + split).alias("place"), F.col("doc_id").isNotNull().alias("known"), "doc_id", "h", kept.alias("doc")
    )
    order = ["known", "doc_id", "h", "doc.text"]
    firsts = rows.groupBy("place").agg(F.max_by("doc.text", F.struct(*order)).alias("text"))
    # One number for each range, of which there are a few for each shuffle partition.
    across = Window.orderBy(F.desc("place"))
    top = F.first("place").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = rows.select("place").distinct().select(F.col("place").alias("here"), F.coalesce(F.lead("place").over(across), top).alias("place"))
    # The first row of the range that follows closes each range.
    handed = follows.join(firsts, "place").select(
        F.col("here").alias("place"), F.lit(False).alias("own"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(False).alias("known"), _long(0).alias("h"), kept.alias("doc")
    )
    down = Window.partitionBy("deal", "place").orderBy(*(F.desc(c) for c in ["own", *order]))
    # A stated number of partitions isn't merged by its bytes: the sketches that follow cost more than the bytes tell.
    # Ranges are dealt in turn, so each partition has as many.
    together = rows.withColumn("own", F.lit(True)).unionByName(handed)
    together = together.withColumn("deal", F.pmod(F.col("place").bitwiseAND(F.lit(1023)) + F.shiftright("place", 10), _long(many)).cast("int")).repartitionById(many, "deal")
    found = together.withColumn("next", F.lead("doc").over(down)).where("own")
    return found.select("doc_id", "doc.text", "doc.digests", F.col("next.text").alias("next_text"), F.col("next.digests").alias("next_digests"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents"))
    n, half = F.char_length("text"), (F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    docs = docs.withColumn("edited", edited).withColumn("edited_digests", paragraphs(F.col("edited")))
    rows = staged(docs.select(
        (F.monotonically_increasing_id() * 2).alias("id"), "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "digests", "edited_digests", "next_digests",
    ))
    # The two lists, and the two pairs, of a row have ids that follow each other.
    both = lambda even, odd: rows.select(F.inline(F.array(F.struct("id", *even), F.struct((F.col("id") + 1).alias("id"), *odd))))
    own, edited, after = (F.col(c) for c in ["digests", "edited_digests", "next_digests"])
    alike = likeness(both([own.alias("a"), edited.alias("b")], [own.alias("a"), after.alias("b")]))
    prints = fingerprint(both([own.alias("digests")], [edited.alias("digests")]))

    def beside(found: DataFrame, value: str, even: str, odd: str) -> DataFrame:
        """`found` with the values of both ids in one row."""
        first = F.col("id").bitwiseAND(_long(1)) == 0
        one = lambda odd, name: F.max(F.when(~first if odd else first, F.col(value))).alias(name)
        return found.groupBy(F.col("id").bitwiseAND(_long(-2)).alias("id")).agg(one(False, even), one(True, odd))

    none = _written(_long(0), F.create_map().cast("map<bigint,string>"), CELLS // 3)  # has no row among the cells
    found = rows.drop("digests", "edited_digests", "next_digests").join(beside(alike, "likeness", "near_edited", "near_next"), "id")
    found = found.join(beside(prints, "fingerprint", "fingerprint", "edited_fingerprint"), "id", "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", none).alias("fingerprint"),
        F.coalesce("edited_fingerprint", none).alias("edited_fingerprint"), "near_edited", "near_next",
    )
