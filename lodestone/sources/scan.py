"""Scanning a directory tree into a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import directory, ecosystem_of, language_of, role_of

#: Directories that are never scanned, and bytes beyond which contents are not read (fixed values).
IGNORED = "node_modules .git dist build coverage .next .turbo out".split()
LARGEST = 512 * 1024


def scan(spark: SparkSession, root: str, repo_id: int = 1) -> DataFrame:
    """Files under ``root`` by path: repo_id, file_id, path, language, role, ecosystem, bytes, modified, contents (null if too large)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    relative = F.expr("substring(p, length(b) + 2)")
    listed = files.select(path.alias("p"), base.alias("b"), "length", "modificationTime", "content").withColumn("path", relative)
    inside = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    kept = listed.where(~F.arrays_overlap(inside, F.array(*[F.lit(d) for d in IGNORED])))
    language = language_of(F.col("path"))
    return kept.select(
        F.lit(repo_id).cast("bigint").alias("repo_id"),
        F.concat(F.lit("file:"), "path").alias("file_id"),
        "path",
        language.alias("language"),
        role_of(F.col("path"), language).alias("role"),
        ecosystem_of(F.col("path")).alias("ecosystem"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
        F.when(F.col("length") <= LARGEST, F.col("content").cast("string")).alias("contents"),
    )


def directories(files: DataFrame) -> DataFrame:
    """All directories that hold a file, at any depth, the root as ``.``."""
    parts = F.split(directory(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select("repo_id", F.explode(F.concat(F.array(F.lit(".")), up)).alias("directory")).distinct()
