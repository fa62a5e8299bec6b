"""How the tests and the bench start Spark."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession


def session(where: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """Times are UTC. What `conf` says comes before what is set here."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Plans of some hundred expressions are built in half the time without the call site of each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    started = SparkConf().setMaster(where).setAll(list((settings | conf).items()))
    return SparkSession.builder.config(conf=started).getOrCreate()
