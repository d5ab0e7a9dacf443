"""Regions of a repository: the directories that hold a manifest, with the files that lie deepest in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import directory, ecosystem_of, language_of, role_of
from lodestone.functions.vocabulary import DEPTHS


def classified(files: DataFrame) -> DataFrame:
    """(repo_id, path) with language, role and ecosystem."""
    language = language_of(F.col("path"))
    return files.select("repo_id", "path", language.alias("language"), role_of(F.col("path"), language).alias("role"), ecosystem_of(F.col("path")).alias("ecosystem"))


def regions(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """The region of every file: the deepest of ``anchors`` (repo_id, region) that contains it, the root otherwise.

    A file's directories are unrolled and joined by equality, so there is no join on prefixes.
    """
    dirs = F.split(directory(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda i: F.array_join(F.slice(dirs, 1, i), "/"))
    unrolled = files.select("repo_id", "path", F.posexplode(F.concat(F.array(F.lit(".")), F.filter(up, lambda d: d != "."))).alias("level", "region"))
    known = anchors.select("repo_id", "region").distinct().withColumn("anchored", F.lit(True))
    met = unrolled.join(known, ["repo_id", "region"], "left").where("anchored or level = 0")
    return met.groupBy("repo_id", "path").agg(F.max_by("region", "level").alias("region"))


def manifest_anchors(files: DataFrame) -> DataFrame:
    return files.where(ecosystem_of(F.col("path")).isNotNull()).select("repo_id", directory(F.col("path")).alias("region")).distinct()


def region_languages(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """Files of each language in each region, most first, and whether it is the primary one (of source files only)."""
    placed = classified(files).join(regions(files, anchors), ["repo_id", "path"]).where("language is not null")
    counted = placed.groupBy("repo_id", "region", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("role") == "source").alias("sources"))
    part = Window.partitionBy("repo_id", "region")
    first = F.row_number().over(part.orderBy(F.col("sources").desc(), "language"))
    return counted.select(
        "repo_id",
        "region",
        "language",
        "files",
        F.row_number().over(part.orderBy(F.col("files").desc(), "language")).alias("position"),
        ((first == 1) & (F.col("sources") > 0)).alias("is_primary"),
    )


def capabilities(region_depths: DataFrame, languages: DataFrame) -> DataFrame:
    """Of each repository: the deepest analysis of its regions (repo_id, region, depth), its languages, and whether it is polyglot.

    It is polyglot when its regions have more than one primary language.
    """
    rank = F.array_position(F.array(*[F.lit(d) for d in DEPTHS]), F.col("depth"))
    deepest = region_depths.groupBy("repo_id").agg(F.max(rank).alias("r")).select("repo_id", F.element_at(F.array(*[F.lit(d) for d in DEPTHS]), F.col("r").cast("int")).alias("depth"))
    spoken = languages.groupBy("repo_id").agg(
        F.countDistinct("language").alias("languages"),
        F.sum("files").alias("files"),
        (F.countDistinct(F.when(F.col("is_primary"), F.col("language"))) > 1).alias("polyglot"),
    )
    return spoken.join(deepest, "repo_id", "left")
