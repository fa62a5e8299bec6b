"""Charts as SVG text, drawn by Spark expressions: one row, and through `named.write_named` one file, for each entity.

An entity's series is its points by week or month, of which a row can hold as many as a chart can show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.named import write_named

WIDTH, HEIGHT, MARGIN = 960, 420, 48


def _escaped(text: Column) -> Column:
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def line_charts(series: DataFrame, at: str, values: list[str], title: str, key: str = "repo_full", most: float | None = None) -> DataFrame:
    """(key, svg): for each entity one chart with a line and dots for each of `values` along `at`; null values leave gaps in the dots only.

    Each dot carries its time, its measure and its value. `most` fixes the top of the scale, as for rates.
    """
    place = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at).cast("timestamp_ntz")).cast("double")
    point = F.struct(F.col(at).cast("timestamp_ntz").alias("chart_at"), place.alias("chart_x"), *(F.col(v).cast("double").alias(v) for v in values))
    grouped = series.dropna(subset=[key, at]).groupBy(key).agg(
        F.sort_array(F.collect_list(point)).alias("points"), F.min(place).alias("x0"), F.max(place).alias("x1"), F.max(F.greatest(*(F.col(v).cast("double") for v in values), F.lit(0.0))).alias("top"),
    )
    top = F.lit(float(most)) if most is not None else F.when(F.col("top") > 0, F.col("top")).otherwise(F.lit(1.0))
    across = F.when(F.col("x1") > F.col("x0"), F.col("x1") - F.col("x0")).otherwise(F.lit(1.0))
    px = lambda p: F.round(F.lit(MARGIN) + (p.chart_x - F.col("x0")) / across * (WIDTH - 2 * MARGIN), 1)
    py = lambda v: F.round(F.lit(HEIGHT - MARGIN) - v / top * (HEIGHT - 2 * MARGIN), 1)
    parts: list[Column] = [
        F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}"><title>{title}: '), _escaped(F.col(key)), F.lit("</title>"),
        F.lit(f'<path class="axes" fill="none" stroke="black" d="M{MARGIN} {MARGIN}V{HEIGHT - MARGIN}H{WIDTH - MARGIN}"/>'),
    ]
    def drawn(v: str, colour: str) -> list[Column]:
        known = F.filter("points", lambda p: p[v].isNotNull())
        dot = lambda p: F.concat(
            F.lit('<circle r="2" cx="'), px(p).cast("string"), F.lit('" cy="'), py(p[v]).cast("string"), F.lit(f'" data-measure="{v}" data-at="'), F.date_format(p["chart_at"], "yyyy-MM-dd HH:mm:ss"),
            F.lit('" data-value="'), p[v].cast("string"), F.lit('"/>'),
        )
        line = F.array_join(F.transform(known, lambda p: F.concat_ws(",", px(p), py(p[v]))), " ")
        return [F.lit(f'<g stroke="{colour}" fill="{colour}"><polyline fill="none" points="'), line, F.lit('"/>'), F.array_join(F.transform(known, dot), ""), F.lit("</g>")]

    for i, v in enumerate(values):
        parts += drawn(v, f"hsl({i * 137 % 360},60%,40%)")
    return grouped.select(key, F.concat(*parts, F.lit("</svg>\n")).alias("svg"))


def write_charts(charts: DataFrame, path: str, key: str = "repo_full") -> None:
    """One SVG file for each entity, drawn and written by executors."""
    write_named(charts.select("svg", key), path, F.col(key), "svg", "text")


def drawn_values(svg: Column) -> Column:
    """The (measure, at, value) of each dot of a chart, to read a file back."""
    found = F.regexp_extract_all(svg, F.lit('data-measure="([^"]*)" data-at="([^"]*)" data-value="([^"]*)"'), F.lit(0))
    at = lambda s, n: F.split_part(s, F.lit('"'), F.lit(n))
    return F.transform(found, lambda s: F.struct(at(s, 2).alias("measure"), at(s, 4).cast("timestamp_ntz").alias("at"), at(s, 6).cast("double").alias("value")))
