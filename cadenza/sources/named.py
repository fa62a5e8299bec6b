"""Files named by a column: one CSV (or text) file for each value, written by executors.

A Spark data source with a task commit. Rows are dealt and ordered by file name, so a task writes whole files, each into
a folder of its own attempt below the target; only when all tasks have succeeded are the files moved to their
names, and a job that fails leaves nothing. Tasks tell the driver their folders, not their files, and it lists one folder
at a time. Work upstream of the writer keeps its partitions.

    spark.dataSource.register(NamedFiles)
    write_named(df, "/shared/out", F.col("slug"))
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "file_name"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store that holds `path`, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None  # none where a task had no rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "csv")
        self.header = [f.name for f in schema if f.name != NAME]
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def _body(self, rows: Iterator[dict]) -> Iterator[bytes]:
        if self.kind == "text":
            yield from ((row[self.header[0]] or "").encode() for row in rows)
            return
        line = io.StringIO()
        write = csv.writer(line, quoting=csv.QUOTE_NOTNULL, lineterminator="\n")  # a null is empty, an empty text is quoted
        write.writerow(self.header)
        for row in rows:
            write.writerow([row[c] for c in self.header])
            if line.tell() > 1 << 20:
                yield line.getvalue().encode()
                line.seek(0)
                line.truncate()
        yield line.getvalue().encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = opened(self.staging)
        at = TaskContext.get()
        own = f"{folder}/{at.partitionId()}-{at.taskAttemptId()}"  # also apart from attempts of an earlier try of the stage
        rows = (row for batch in iterator for row in batch.to_pylist())
        written = None
        for name, found in groupby(rows, lambda row: row[NAME]):
            store.create_dir(own, recursive=True)
            with store.open_output_stream(f"{own}/{name}") as out:
                for part in self._body(found):
                    out.write(part)
            written = own
        return _Written(written)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        for message in messages:
            for file in store.get_file_info(fs.FileSelector(message.folder)) if message and message.folder else []:
                store.move(file.path, f"{folder}/{file.base_name}")  # in place of what has that name
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = opened(self.staging)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema)


def texts(df: DataFrame) -> DataFrame:
    """Every column as the text that a CSV holds: arrays and structs as JSON."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*((F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string")).alias(f.name) for f in df.schema))


def write_named(df: DataFrame, path: str, name: Column, extension: str = "csv", kind: str = "csv", order: tuple[str, ...] = (), combined: str | None = None) -> None:
    """Writes the rows of each value of `name` to `path`/value.extension, in `order`; files of the same name are replaced, others stay.

    Rows without a name go to ".extension" of an empty one. With `combined` all rows go to the file of that name too, in the same
    job. With kind "text" the first column is a file's whole body.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    own = F.concat(F.coalesce(F.replace(name, F.lit("/"), F.lit("__")), F.lit("")), F.lit(f".{extension}"))
    named = df.withColumn(NAME, own if combined is None else F.explode(F.array(own, F.lit(f"{combined}.{extension}"))))
    dealt = named.repartition(NAME).sortWithinPartitions(NAME, *order)
    texts(dealt).write.format("named_files").mode("append").option("kind", kind).save(path)


def write_single(df: DataFrame, path: str, name: str, order: tuple[str, ...] = ()) -> None:
    """Writes all rows to the one file `path`/name.csv. They meet after a shuffle, so what makes them runs in all its tasks."""
    write_named(df, path, F.lit(name), order=order)
