"""Graphs on disk: read with a version check, replaced as a whole, skipped when nothing changed.

A graph is a folder with one Parquet table each for nodes and edges and a ``meta`` table. A new one is written beside the
old and takes its place by a rename of folders, so that a reader sees either the old graph or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.graph import Graph

SCHEMA_VERSION = 4


class WrongVersion(ValueError):
    pass


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 of each repository's files (repo_id, path, bytes, modified): equal for equal sets, in any order.

    A digest of every row is added up into sums, so that no repository is gathered in one task.
    """
    row = F.sha2(F.concat_ws("\x00", "path", F.coalesce(F.col("bytes").cast("string"), F.lit("")), F.coalesce(F.col("modified").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = files.select("repo_id", *[p.alias(f"s{i}") for i, p in enumerate(parts)]).groupBy("repo_id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)], F.count(F.lit(1)).alias("n"))
    return sums.select("repo_id", F.sha2(F.concat_ws("|", "n", *[f"s{i}" for i in range(5)]), 256).alias("source_hash"))


def write_graph(graph: Graph, path: str, source_hash: str = "") -> None:
    """Replace the graph at ``path`` as a whole; nodes are laid out by kind and edges by type."""
    spark = graph.nodes.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    graph.nodes.write.partitionBy("kind").parquet(f"{staged}/nodes")
    graph.edges.write.partitionBy("type").parquet(f"{staged}/edges")
    spark.createDataFrame([(SCHEMA_VERSION, source_hash)], "schema_version int, source_hash string").coalesce(1).write.parquet(f"{staged}/meta")
    target, fs, Path = _paths(spark, path)
    old = Path(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(Path(staged), target)
    fs.delete(old, True)


def stored_hash(spark: SparkSession, path: str) -> str | None:
    target, fs, _ = _paths(spark, path)
    return spark.read.parquet(f"{path}/meta").first()["source_hash"] if fs.exists(target) else None


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The graph at ``path``; one of another schema version is refused."""
    version = spark.read.parquet(f"{path}/meta").first()["schema_version"]
    if version != SCHEMA_VERSION:
        raise WrongVersion(f"schema version {version}; this reads {SCHEMA_VERSION}")
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def write_if_changed(graph: Graph, path: str, source_hash: str) -> bool:
    """Write unless the graph there was made from the same sources."""
    if stored_hash(graph.nodes.sparkSession, path) == source_hash:
        return False
    write_graph(graph, path, source_hash)
    return True
