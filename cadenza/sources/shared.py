"""Tables written once to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a local temporary one only in local mode where that is unset, as in tests.

    It is deleted when the driver ends.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not shared:
            if not sc._jsc.sc().isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-cadenza-")
        _folders[app] = f"{shared.rstrip('/')}/cadenza-{app}"
        atexit.register(drop, spark, _folders[app])
    return _folders[app]


def drop(spark: SparkSession, path: str) -> None:
    """Best effort: a session that has ended already leaves the folder to the cluster's own cleaning."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(sc._jsc.hadoopConfiguration()).delete(found, True)


def new_path(spark: SparkSession, name: str = "") -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{folder(spark)}/{name}{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: short lineage, column pruning, known size.

    A lost executor costs a reread of the files, never a recomputation of `df`.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a `staged` table that nothing will read again."""
    drop(df.sparkSession, df._staged_path)
