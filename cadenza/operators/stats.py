"""Summaries of a column by entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a place that slots leave out: 65,536 slots to an octave. Further, lesser numbers would deal each slot found again.
SLOT_BITS = (35,)
#: Places of an octave, and the octave of the least number there is.
_OCTAVE, _LEAST = 1 << 51, -1074


def _place(v: Column) -> Column:
    """A long in the order of doubles that aren't NaN: exponent and mantissa, negative for negative ones."""
    size = F.abs(v)
    near = F.floor(F.log2(size)).cast("int")
    power = F.when(size < F.pow(F.lit(2.0), near), near - 1).otherwise(near)  # a logarithm may round up
    # Two factors, as the least power of two has no inverse.
    scaled = size * F.pow(F.lit(2.0), -F.floor(power / 2)) * F.pow(F.lit(2.0), -(power - F.floor(power / 2)))
    inside = (power - _LEAST).cast("long") * _OCTAVE + F.floor((scaled - 1) * float(_OCTAVE))
    at = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit((1025 - _LEAST) * _OCTAVE)).otherwise(inside + 1)
    return F.when(v < 0, -at).otherwise(at)


def known(v: Column) -> Column:
    """`v` as a double, with null for NaN: missing values have one form."""
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def percentiles_of(df: DataFrame, values: dict[str, Column], fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, one array for each of `values`): exact interpolated percentiles of several measures at once, for groups of any size.

    Nulls and NaN don't count; an array is null where a measure has no value, and groups without any value are left out. Equal
    values are counted first. A group's values are dealt by place into slots whose order is that of the values; counts by
    slot tell which slots hold the wanted ranks, and only those are put in order. So no task holds a group: it holds a
    group's slots, whose number has a bound, or values that agree to nearly five digits.
    """
    keys = list(keys)
    by = [*keys, "measure"]
    rows = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("measure"), known(c).alias("v")) for i, c in enumerate(values.values())))).alias("m"))
    counted = rows.select(*keys, "m.measure", "m.v").where("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("n")).withColumn("place", _place(F.col("v")))
    at = [F.lit(float(f)) * (F.col("total") - 1) for f in fractions]
    ranks = [F.floor(a) for a in at] + [F.ceil(a) for a in at]
    left, held = counted.withColumns({"upper": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "total": F.lit(None).cast("long")}), None
    for bits in SLOT_BITS:
        left = left.withColumn("slot", F.shiftright("place", bits))
        slots = left.groupBy(*by, "upper", "base", "total", "slot").agg(F.sum("n").alias("m"))
        within = Window.partitionBy(*by, "upper")
        down = within.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        total = F.coalesce("total", F.sum("m").over(within))
        slots = slots.select(*by, "slot", "m", (F.col("base") + F.coalesce(F.sum("m").over(down), F.lit(0))).alias("before"), total.alias("total"))
        held = slots.where(F.exists(F.array(*ranks), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m"))))
        # Null keys join as well, as a group of null is a group.
        held = held.select(*(F.col(k).alias(f"held_{k}") for k in by), F.col("slot").alias("held_slot"), F.col("before").alias("held_base"), F.col("total").alias("held_total"))
        same = (F.col("slot") == F.col("held_slot")) & (F.col("measure") == F.col("held_measure"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"held_{k}"))
        left = left.join(held, same).select(*by, "v", "n", "place", F.col("slot").alias("upper"), F.col("held_base").alias("base"), F.col("held_total").alias("total"))
    inside = Window.partitionBy(*by, "upper").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.withColumn("upto", F.col("base") + F.sum("n").over(inside))
    holding = lambda r: F.max(F.when((r >= F.col("upto") - F.col("n")) & (r < F.col("upto")), F.col("v")))
    n = len(fractions)
    found = found.groupBy(*by).agg(F.max("total").alias("total"), F.array(*(holding(r) for r in ranks)).alias("vs"))
    low, high = (lambda i: F.col("vs")[i]), (lambda i: F.col("vs")[n + i])
    mid = lambda i: F.when(low(i) == high(i), low(i)).otherwise(low(i) + (at[i] - F.floor(at[i])) * (high(i) - low(i)))
    found = found.select(*by, F.array(*map(mid, range(n))).alias("p"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("measure") == i, F.col("p"))).alias(name) for i, name in enumerate(values)))


def percentiles(df: DataFrame, value: Column, fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, p): `percentiles_of` one measure."""
    found = percentiles_of(df, {"p": value}, fractions, keys)
    return found if keys else found.where("p IS NOT NULL")


def grouped_medians(df: DataFrame, names: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """(keys, new names): the exact medians of columns (new name: column), null where a group has no value; groups without any are left out."""
    found = percentiles_of(df, {new: F.col(old) for new, old in names.items()}, [0.5], keys)
    return found.select(*keys, *(F.col(new)[0].alias(new) for new in names))


def medians(df: DataFrame, column: str, name: str, key: str = "repo_full") -> DataFrame:
    """(key, name): the exact median by key, null where a key has no value; rows without key go."""
    rows = df.dropna(subset=[key])
    found = percentiles(rows, F.col(column), [0.5], [key]).select(key, F.col("p")[0].alias(name))
    return rows.select(key).distinct().join(found, key, "left")


def box(df: DataFrame, value: str, key: str = "repo_full") -> DataFrame:
    """Box-plot numbers: quartiles, whiskers (extreme values within 1.5 quartile ranges) and the number of outliers. NaN is missing."""
    rows = df.select(key, known(F.col(value)).alias("v")).dropna(subset=[key, "v"])
    cut = percentiles(rows, F.col("v"), (0.25, 0.5, 0.75), [key])
    cut = cut.select(key, F.col("p")[0].alias("q1"), F.col("p")[1].alias("med"), F.col("p")[2].alias("q3"))
    inside = F.col("v").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return rows.join(cut, key).groupBy(key, "q1", "med", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"), F.count("*").alias("n"),
    )


def outliers(df: DataFrame, value: str, key: str = "repo_full") -> DataFrame:
    """(key, v, n): the values beyond the whiskers that `box` counts, each once with how often it comes."""
    rows = df.select(key, known(F.col(value)).alias("v")).dropna(subset=[key, "v"])
    cut = percentiles(rows, F.col("v"), (0.25, 0.75), [key]).select(key, F.col("p")[0].alias("q1"), F.col("p")[1].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    beyond = ~F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(key, "v").agg(F.count("*").alias("n")).join(cut, key).where(beyond).select(key, "v", "n")


def describe(df: DataFrame, value: str, key: str = "repo_full") -> DataFrame:
    """Count, mean, sample deviation, extremes and percentiles 50, 90, 95 and 99."""
    v = known(F.col(value))
    found = df.dropna(subset=[key]).groupBy(key).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"),
        F.percentile(v, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99)))).alias("p"), F.max(v).alias("most"),
    )
    return found.select(key, "n", "mean", "std", "least", *(F.col("p")[i].alias(name) for i, name in enumerate(("p50", "p90", "p95", "p99"))), "most")


def time_range(df: DataFrame, time: str, key: str = "repo_full") -> DataFrame:
    """First and last time, their distance in days and the number of rows."""
    first, last = F.min(time), F.max(time)
    days = F.timestamp_diff("MICROSECOND", first, last) / F.lit(8.64e10)
    return df.dropna(subset=[key]).groupBy(key).agg(first.alias("first_time"), last.alias("last_time"), days.alias("range_days"), F.count("*").alias("n"))


def entities(df: DataFrame, key: str = "repo_full", most: int | None = None) -> DataFrame:
    """Distinct entities in order, or the first `most` of them."""
    found = df.select(key).dropna().distinct().orderBy(key)
    return found if most is None else found.limit(most)
