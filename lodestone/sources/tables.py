"""Reading the tables of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """Size and time of change of a table's file or folder, to tell one delivery from another."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return status.getLen(), status.getModificationTime()
