"""Tables that cut lineage: written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), a new temporary one."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    What reads the result recomputes nothing and survives the loss of any executor.
    The files stay until the owner of the shared folder clears it.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/locusweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
