"""Tables that cut lineage: written once to the folder all executors share, and read from there by every branch of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
ROWS = 250_000  # rows of a part that sorts and aggregations hold in memory


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new temporary one where that is unset and Spark runs in one process."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: what reads it recomputes nothing and survives the loss of executors.

    The files stay until the owner of the folder clears it.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/locusweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: list[str], rows: int = ROWS) -> DataFrame:
    """``df`` by a hash of ``by`` in parts of about ``rows`` rows, as many as shuffle partitions at least: the memory of a task does not grow with the table.

    Aggregations, joins and windows that ``by`` serves need no shuffle after it.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *by)
