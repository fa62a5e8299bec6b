"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.shared import discard, staged

__all__ = ["discard", "staged"]

#: The white space that texts are split at, and what lies between, as regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, which gives a task's freed memory back when it ends: workers live on, and what they keep adds up over the stages."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return task


def values(column: pa.Array, step: int = 500) -> Iterator:
    """The values of an Arrow column, of which `step` at a time are Python objects."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def word_count(text: Column) -> Column:
    """Number of words of `text` as a long; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the map that `maybe_wanted` broadcasts, 64 to a row: 131,072 rows of two longs at most.
MAP_BITS = 1 << 23


def _spot(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(MAP_BITS))


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """`rows` with `map_hit`: whether `key` may be in the first column of `wanted`; False is certain."""
    bits = wanted.select(_spot(wanted.columns[0]).alias("spot")).groupBy(F.shiftright("spot", 6).alias("map_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("map_mask")
    )
    near = rows.join(F.broadcast(bits), F.shiftright(_spot(key), 6) == F.col("map_word"), "left")
    hit = F.getbit("map_mask", _spot(key).bitwiseAND(F.lit(63)).cast("int")) == 1
    return near.withColumn("map_hit", F.coalesce(hit, F.lit(False))).drop("map_word", "map_mask")


def maybe_wanted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose `key` may be in the first column of `wanted`; an exact join follows.

    It drops most rows before that join shuffles them. The map has MAP_BITS bits, so what is broadcast
    is bounded whatever the tables' sizes; a map that fills up lets more rows through, no more.
    """
    return _marked(rows, key, wanted).where("map_hit").drop("map_hit")


def sifted(rows: DataFrame, key: str, some: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows`, with `rule` applied to those whose `key` may be in the first column of `some`.

    The others pass as they are, so a rule that shuffles its rows moves few of them. `rule` must
    return unchanged the rows whose key isn't in `some`.
    """
    marked = _marked(rows, key, some)
    return marked.where("NOT map_hit").drop("map_hit").unionByName(rule(marked.where("map_hit").drop("map_hit")))
