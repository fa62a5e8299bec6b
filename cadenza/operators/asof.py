"""As-of joins: for each left row the first right row at or after its time, or the last at or before it, within a key.

Right rows are dealt into ranges of (key, time) whose bounds come from a sample of them, so ranges are as narrow as
they are dense: a key whose rows all lie in one day has many. Both sides are laid together and one running value is taken
along (key, time) inside each range; a RANGE frame keeps equal times together. What a range lacks at its end is the
nearest right row of the ranges around it, one row for each range. Left rows of a range are dealt over SALTS tasks,
each with a copy of the range's (narrow) right rows, so left rows that crowd between two right ones are spread too.
The left side is read once and shuffled once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges for each shuffle partition, the most bounds, sampled right rows for each range, and the tasks for a range's left rows.
RANGES, MOST_BOUNDS, SAMPLED, SALTS = 4, 2048, 64, 4


def _position(key: Column, time: Column, kinds: tuple[T.DataType, T.DataType]) -> tuple[Column, Column]:
    """(k, t) in forms that JSON keeps exactly: keys as integers or text, times in microseconds."""
    k = key if isinstance(kinds[0], (T.IntegralType, T.StringType)) else key.cast("string")
    if isinstance(kinds[1], T.TimestampType):
        return k, F.unix_micros(time)
    return k, F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def _sampled(rights: DataFrame, most: int) -> list[tuple]:
    """A uniform sample of the distinct (k, t), those of the least hashes, in order."""
    found = rights.select(F.xxhash64("k", "t").alias("h"), "k", "t").orderBy("h").limit(most).collect()
    return sorted((r.k, r.t) for r in found)


def _bounds(sample: list[tuple], ranges: int) -> list[tuple]:
    """At most `ranges` - 1 places that part the sample into equal shares."""
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def _range_of(bounds: list[tuple], kind: T.DataType) -> Column:
    """How many bounds are less than the columns (k, t): first how many groups of them, then within a group."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [[{"k": k, "t": t} for k, t in bounds[i : i + step]] for i in range(0, len(bounds), step)]
    text = lambda x: F.lit(json.dumps(x))  # noqa: E731  one literal for all
    pair = f"struct<k:{kind.simpleString()},t:bigint>"
    less = lambda b: (b.k < F.col("k")) | ((b.k == F.col("k")) & (b.t < F.col("t")))
    full = F.size(F.filter(F.from_json(text([g[-1] for g in groups]), f"array<{pair}>"), less))
    inside = F.get(F.from_json(text(groups), f"array<array<{pair}>>"), full)
    return F.when(full == len(groups), F.lit(len(bounds))).otherwise(full * step + F.size(F.filter(inside, less)))


def asof(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: dict[str, str], backward: bool = False, keep_all: bool = False
) -> DataFrame:
    """`left` with columns `take` (new name: column of `right`) of the nearest right row of its key.

    Forward: the first at or after its time; backward: the last at or before it; equal times match. Of right rows with equal
    key and time the one with the least taken values counts. Left rows without a match, or with a null key or time, go, unless
    `keep_all` (then with nulls). Right rows with a null key or time match nothing. Repeated left rows stay.
    """
    values = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(take.values())))
    named = lambda df, time: _position(F.col(key), F.col(time), (df.schema[key].dataType, df.schema[time].dataType))
    rk, rt = named(right, right_time)
    rights = right.dropna(subset=[key, right_time]).select(rk.alias("k"), rt.alias("t"), values.alias("v"))
    k, t = named(left, left_time)
    placed = left.select(F.struct("*").alias("row"), k.alias("k"), t.alias("t"))
    placed = placed if keep_all else placed.where("k IS NOT NULL AND t IS NOT NULL")
    near = _nearest(placed, rights.groupBy("k", "t").agg(F.min("v").alias("v")), backward)
    match = near.select("row", F.when(F.col("near.k") == F.col("k"), F.col("near.v")).alias("v"))
    return (match if keep_all else match.where("v IS NOT NULL")).select("row.*", *(F.col(f"v.c{i}").alias(name) for i, name in enumerate(take)))


def _with_ends(ranges: DataFrame, count: int) -> DataFrame:
    """`ranges` (g, first, last, ...) for every g below `count`, with the nearest right row before and after each."""
    spine = ranges.sparkSession.range(count).select(F.col("id").cast("int").alias("g"))
    across = Window.orderBy("g")  # one row a range
    before = F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
    return spine.join(ranges, "g", "left").withColumns({"before": before, "after": after})


def _nearest(placed: DataFrame, rights: DataFrame, backward: bool) -> DataFrame:
    """`placed` with `near`, the nearest right row in the order of (key, time), of whatever key."""
    ranges = min(MOST_BOUNDS, RANGES * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(_sampled(rights, SAMPLED * ranges), ranges)
    place = _range_of(bounds, rights.schema["k"].dataType)
    rights = rights.select(place.alias("g"), F.struct("k", "t", "v").alias("item"))
    placed = placed.withColumn("g", F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), place))
    ends = _with_ends(rights.groupBy("g").agg(F.min("item").alias("first"), F.max("item").alias("last")), len(bounds) + 1)
    beyond = ends.select("g", F.col("before" if backward else "after").alias("beyond"))
    # A row's salt is its own hash, so a task that runs again deals it as before.
    lefts = placed.withColumns({"salt": F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"), "item": F.lit(None).cast(rights.schema["item"].dataType)})
    copies = rights.select("g", "item", F.col("item.k").alias("k"), F.col("item.t").alias("t"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    both = lefts.unionByName(copies, allowMissingColumns=True)
    order = [F.asc("k"), F.asc("t")] if backward else [F.desc("k"), F.desc("t")]
    along = Window.partitionBy("g", "salt").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("inside", F.last("item", ignorenulls=True).over(along)).where("row IS NOT NULL")
    # One row for each range, of which there are MOST_BOUNDS and one at most.
    return near.join(F.broadcast(beyond), "g", "left").withColumn("near", F.coalesce("inside", "beyond"))


def next_after(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, name: str) -> DataFrame:
    """`left` with `name`, the least right time >= its own; rows without one, or with null key or time, go."""
    return asof(left, right, key, left_time, right_time, {name: right_time})


def last_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: dict[str, str], keep_all: bool = False) -> DataFrame:
    """`left` with columns of the last right row at or before its own time."""
    return asof(left, right, key, left_time, right_time, take, True, keep_all)
