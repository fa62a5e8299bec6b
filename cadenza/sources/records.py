"""Large CSV files whose text holds line ends, read in several tasks.

Where a record starts depends on the quotes of everything before it. A line leaves the reader inside or outside of quotes, told by
whether it came in inside; so each line is a map of two states, and maps compose. The first pass composes them for each split of a file; one row
for each split tells then where it begins. The second pass cuts each split into records, and only the pieces of records that run
over a split's end are shuffled. Whole texts are kept; a record must fit a row.

Quotes are as the sink writes them: a field that holds a quote, a comma or a line end is quoted, quotes inside are doubled. A quote within an
unquoted field is text. Files may end without a line end, in CRLF, or inside a quote that never closes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.sources.shared import staged

#: At most so many rows, one for each split, are broadcast; beyond it lines are dealt by split instead.
HELD = 20_000

#: A line that ends inside quotes, if it starts outside. Possessive throughout: no backtracking, and no recursion in the length of a line.
UNCLOSED = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+"[^"]*+(?:""[^"]*+)*+\z'

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}

_SPLIT = ["path", "start"]


def _after(from_outside: np.ndarray, from_inside: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line ends inside quotes, if the first one starts `inside`."""
    fixed, swaps = from_outside == from_inside, np.cumsum(from_outside & ~from_inside)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))  # the last line whose end doesn't depend on its start
    known = last >= 0
    base = np.where(known, from_outside[last], inside)
    return base ^ ((swaps - np.where(known, swaps[last], 0)) & 1).astype(bool)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((path, start), first row, row after the last) of each split's rows in a batch."""
    paths = batch["path"].dictionary_encode()
    codes, starts = paths.indices.to_numpy(), batch["start"].to_numpy()
    edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(codes)], strict=True):
        if hi > lo:
            yield (paths.dictionary[int(codes[lo])].as_py(), int(starts[lo])), lo, hi


def _flags(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch[c].slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("from_outside", "from_inside"))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a split's lines: where it ends from either start, and whether a record starts in it when it begins inside."""
    key, ends, begins = None, None, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": key[0], "start": key[1], "end_outside": ends[0], "end_inside": ends[1], "begins": begins}])

    for batch in batches:
        for split, lo, hi in _runs(batch):
            if split != key:
                if key is not None:
                    yield row()
                key, ends, begins = split, [False, True], False
            flags = _flags(batch, lo, hi)
            from_inside = _after(*flags, ends[1])
            begins = begins or not ends[1] or not from_inside[:-1].all()
            ends = [bool(_after(*flags, ends[0])[-1]), bool(from_inside[-1])]
    if key is not None:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split. A `piece` is part of one that starts in split `origin` and runs over that split's end."""
    key, inside, origin, lines, own, first = None, False, None, [], False, False
    out: list[tuple] = []

    def put(piece: bool) -> None:
        nonlocal lines, first
        if lines:
            text = "\n".join(lines)
            named = own and first and text.strip("\r") != ""
            first = first and not named
            out.append((key[0], key[1], key[1] if own else origin, text, piece, named))
            lines = []

    def flushed() -> pa.RecordBatch:
        nonlocal out
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        found, out = [pa.array(c, t) for c, t in zip(columns, types, strict=True)], []
        return pa.RecordBatch.from_arrays(found, names=["path", "start", "origin", "record", "piece", "header"])

    for batch in batches:
        values = batch["value"].to_pylist()
        for split, lo, hi in _runs(batch):
            if split != key:
                put(not own or inside)
                key, inside, origin, own = split, batch["inside"][lo].as_py(), batch["origin"][lo].as_py(), False
                first = key[1] == 0
            after = _after(*_flags(batch, lo, hi), inside)
            starts = lo + np.flatnonzero(~np.concatenate([[inside], after[:-1]]))
            at = lo
            for start in starts.tolist():
                lines += values[at:start]
                put(not own)
                own, at = True, start
            lines += values[at:hi]
            inside = bool(after[-1])
        yield flushed()
    put(not own or inside)
    yield flushed()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, its split and the two flags. A split's lines come in their order."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    quoted = F.col("value").contains('"')
    return lines.withColumns({
        "from_outside": quoted & F.col("value").rlike(UNCLOSED),
        "from_inside": ~quoted | F.concat(F.lit('"'), "value").rlike(UNCLOSED),
    })


def _splits(lines: DataFrame) -> DataFrame:
    """(path, start, inside, origin): whether each split begins inside quotes, and the last split before it in which a record starts."""
    ends = lines.select(*_SPLIT, "from_outside", "from_inside").mapInArrow(_compose, "path string, start bigint, end_outside boolean, end_inside boolean, begins boolean")
    w = Window.partitionBy("path").orderBy("start")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    swap = F.sum((F.col("end_outside") & ~F.col("end_inside")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("swaps", swap)
    fixed = F.last(F.when(F.col("end_outside") == F.col("end_inside"), F.struct("end_outside", "swaps")), ignorenulls=True).over(earlier)
    ends = ends.withColumns({"fixed": fixed, "before": F.lag("swaps", 1, 0).over(w)})
    odd = (F.col("before") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    ends = ends.withColumn("inside", F.coalesce("fixed.end_outside", F.lit(False)) != odd)
    starts_here = ~F.col("inside") | F.col("begins")
    return ends.select(*_SPLIT, "inside", F.last(F.when(starts_here, F.col("start")), ignorenulls=True).over(earlier).alias("origin"))


def records(spark: SparkSession, path: str, held: int = HELD) -> DataFrame:
    """(path, header, record): every record of the CSV files at `path` as text, without blank ones; `header` is each file's first.

    The files are read twice. Should they be split otherwise the second time, at places that the first pass hasn't seen, the job fails.
    """
    lines = _lines(spark, path)
    splits = staged(_splits(lines)).withColumn("seen", F.lit(True))
    small = splits.limit(held + 1).count() <= held
    if not small:  # the join shuffles the lines, so their order is kept by hand
        lines = lines.withColumn("place", F.monotonically_increasing_id())
    found = lines.join(F.broadcast(splits) if small else splits.hint("shuffle_merge"), _SPLIT, "left")
    checked = F.when(F.col("seen"), F.col("inside")).otherwise(F.raise_error(F.lit("the files were split at other places than before: read again")).cast("boolean"))
    found = found.withColumn("inside", checked)
    if not small:
        found = found.repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "place")
    cut = found.select(*_SPLIT, "value", "from_outside", "from_inside", "inside", "origin").mapInArrow(
        _cut, "path string, start bigint, origin bigint, record string, piece boolean, header boolean"
    )
    cut = staged(cut)  # the text is cut once, for whole records and for pieces
    parts = F.sort_array(F.collect_list(F.when(F.col("piece"), F.struct("start", "record"))))
    mended = cut.where("piece").groupBy("path", "origin").agg(parts.alias("parts"), F.max("header").alias("header"))
    mended = mended.select("path", "header", F.array_join(F.transform("parts", lambda p: p.record), "\n").alias("record"))
    whole = cut.where("NOT piece").select("path", "header", "record").unionByName(mended)
    return whole.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """The CSV files at `path` with every column as text, and `file`; columns are those of the first file, as Spark's reader takes them."""
    names = spark.read.option("header", True).options(**OPTIONS).csv(path).columns
    rows = records(spark, path).where("NOT header")
    if not names:
        return rows.select(F.col("path").alias("file")).limit(0)
    row = F.from_csv("record", ", ".join(f"c{i} STRING" for i in range(len(names))), OPTIONS)
    return rows.select(row.alias("row"), F.col("path").alias("file")).select(*(F.col(f"row.c{i}").alias(name) for i, name in enumerate(names)), "file")
