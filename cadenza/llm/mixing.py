"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected target/source_size times in the mix. Laid end to end, the
expected copies of a source's documents form a line; one offset per source shifts it, and a document
is emitted once for each integer boundary that its stretch crosses. As all stretches of a source are
equally long, a document's place on the line follows from its rank.

The order along the line is (size class, hash of doc_id, size, doc_id, hash of the text). Size classes are eighths of
powers of two, so the words taken follow the target closely whatever the order inside a class. The
rank is the sum of three counts, each taken where the data are small or already split:

  documents in lower size classes of the source        one row per class
  documents in lower hash slots of the class            one row per slot, 65,536 at most
  documents before this one in the slot                 row_number inside (source, class, slot)

so that a source with a third of all rows is spread over its (class, slot) cells; no window holds a
whole source's documents. With 65,536 slots a cell holds a few hundred documents of 10^11. Sources alone are
ranked in one task: a row of numbers each, so millions of sources are still small.

Defined results: null text has size 0. A null source is a source of its own, after all others. A
source without words has target 0 and copies 0. Repeated rows are separate documents. An empty table
gives an empty mix. Texts of any length count whole. Rows that share doc_id, size and text are
interchangeable. Columns beside doc_id, text and source pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import staged, table, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = "mix"


def _targets(cells: DataFrame, weights: Sequence[int], budget: float, most: int, seed: str) -> DataFrame:
    """A row per source: its size, target and offset. `cells` has sk and the words w of each cell.

    Sources are ranked in one window: the table has a row per source, not per document.
    """
    everything = Window.orderBy("sk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy("sk")) - 1) % len(weights) + 1)
    sources = cells.groupBy("sk").agg(F.sum("w").alias("source_size")).select(
        "sk", "source_size", weight.alias("wt"), (F.lit(most) * F.col("source_size")).alias("cap"),
        (F.lit(budget) * F.sum("source_size").over(everything)).alias("budget"),
    )
    # Water filling: in the order of cap/weight, the first source whose even share stays under its cap sets the level.
    order = Window.orderBy(F.col("cap") / F.col("wt"), "sk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("wt").over(everything) - F.coalesce(F.sum("wt").over(before), F.lit(0))
    )
    level = sources.withColumns({"level": level, "rn": F.row_number().over(order)})
    holds = F.when(F.col("level") <= F.col("cap") / F.col("wt"), F.struct("rn", "level"))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.min(holds).over(everything)["level"] * F.col("wt")), F.col("cap").cast("double"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "sk")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return level.select("sk", "source_size", target.alias("target"), offset.alias("u"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies): `row` holds the columns of `docs`, copies is 0 to `most`."""
    size = word_count(F.col("text"))
    docs = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("z")).alias("sk"),
        size.alias("size"),
        F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), F.lit("")).alias("slot"),
    ).withColumn("bits", F.length(F.bin("size"))).withColumn(
        "class", F.expr("if(size < 8, size, bits * 8 + (shiftright(size, bits - 4) & 7))")
    ).drop("bits")
    cells = staged(docs.groupBy("sk", "class", "slot").agg(F.count("*").alias("n"), F.sum("size").alias("w")))
    classes = cells.groupBy("sk", "class").agg(F.sum("n").alias("n"))
    running = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    places = (
        cells.withColumn("in_class", sum_before(running("sk", "class").orderBy("slot")))
        .join(classes.select("sk", "class", sum_before(running("sk").orderBy("class")).alias("in_source")), ["sk", "class"])
        .join(_targets(cells, weights, budget, most, seed), "sk")
        .select("sk", "class", "slot", (F.col("in_class") + F.col("in_source")).alias("before"), "source_size", "target", "u")
    )
    here = Window.partitionBy("sk", "class", "slot").orderBy("size", "row.doc_id", F.xxhash64("row.text"))
    ranked = docs.withColumn("rn", F.row_number().over(here)).join(places, ["sk", "class", "slot"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ends = F.floor((F.col("before") + F.col("rn")) * share + F.col("u"))
    starts = F.floor((F.col("before") + F.col("rn") - 1) * share + F.col("u"))
    return ranked.select("row", "size", "source_size", "target", (ends - starts).cast("long").alias("copies"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as the plan says."""
    planned = plan_mix(docs, **parameters).filter("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce('a' || source, 'z') AS sk, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(substr(md5(CAST(doc_id AS VARCHAR)), 1, 4), '') AS slot
  FROM documents),
classed AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + ((size >> CAST(length(bin(size)) - 4 AS INTEGER)) & 7) END AS class FROM docs),
sources AS (
  SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY sk),
weighted AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY sk) - 1) % 3 + 1] AS wt, 2 * source_size AS cap FROM sources),
shares AS (
  SELECT *, row_number() OVER (ORDER BY cap / wt, sk) AS rn,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / wt, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighted),
held AS (
  SELECT arg_min(level, rn) AS level FROM shares WHERE level <= cap / wt),
targets AS (
  SELECT s.sk, s.source_size, CAST(coalesce(least(CAST(s.cap AS DOUBLE), h.level * s.wt), s.cap) AS DOUBLE) AS target,
    CAST('0x' || substr(md5('mix' || s.sk), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM shares s CROSS JOIN held h),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sk ORDER BY class, slot, size, doc_id) AS r FROM classed),
placed AS (
  SELECT r.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS share
  FROM ranked r JOIN targets t USING (sk))
SELECT doc_id, size, source_size, target, CAST(floor(r * share + u) - floor((r - 1) * share + u) AS BIGINT) * size AS taken FROM placed
"""
