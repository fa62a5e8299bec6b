"""CSV in and out, and tables that may be missing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.sources import records


def exists(spark: SparkSession, path: str) -> bool:
    """Whether `path` is there, on whatever store Spark reads."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, lines_in_text: bool = True, with_file: bool = False, split: bool = False) -> DataFrame:
    """A headered CSV as `schema`, by column name; text may hold quotes and line ends.

    Columns that the file lacks are null, so an empty file is an empty table. "NaN" is a missing number. Arrays are read as JSON text. A file whose
    text holds line ends is one task, or with `split` several (`records`, which reads it twice: for large files); without `lines_in_text` large files
    are split as they are. `with_file` adds each row's file.
    """
    if split:
        raw = records.read_texts(spark, path)
    else:
        raw = spark.read.option("header", True).option("multiLine", lines_in_text).option("quote", '"').option("escape", '"').csv(path)
    columns = []
    for f in schema:
        if f.name not in raw.columns:
            column = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.ArrayType):
            column = F.from_json(F.col(f.name), f.dataType)
        else:
            column = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                column = F.when(~F.isnan(column), column)
        columns.append(column.alias(f.name))
    known = raw if {f.name for f in schema} & {*raw.columns} else raw.limit(0)
    return known.select(*columns, *([(F.col("file") if split else F.col("_metadata.file_path")).alias("file")] if with_file else []))


def write_csv(df: DataFrame, path: str, single: bool = False, by: str | None = None) -> None:
    """Overwrites `path` with headered CSV; arrays and structs as JSON text. `single` writes one part, after a shuffle: what makes the rows keeps its tasks.

    With `by` the rows of each value of that column go to a folder of their own, `by`=value; the whole is still one table.
    """
    nested = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    df = df.withColumns(nested) if nested else df
    writer = (df.repartition(1) if single else df).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def first_available(spark: SparkSession, options: Sequence[tuple[str, Callable[[str], DataFrame]]], what: str = "input") -> DataFrame:
    """The first option (path, reader) whose path exists; FileNotFoundError if none does."""
    for path, reader in options:
        if exists(spark, path):
            return reader(path)
    raise FileNotFoundError(f"{what}: none of {[p for p, _ in options]} exists")


def combined(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of per-repository tables, matched by column name; columns that one lacks are null there."""
    if not tables:
        raise ValueError("there is no table to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
