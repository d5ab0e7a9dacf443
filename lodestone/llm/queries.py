"""The problems of TESTDATA.md on training data: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.leakage import leaks
from lodestone.llm.mixing import Mixture, mix
from lodestone.llm.provenance import foreign_files
from lodestone.llm.subjects import assign_subjects
from lodestone.llm.topn import top_n
from lodestone.llm.validity import check_files, validity_rates
from lodestone.plans.staging import join_small
from lodestone.plans.standing import standing
from lodestone.sources.tables import table


def measured_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing metrics with the standing node they name: repo_id, file_id, kind, name, node_id, importance."""
    metrics = standing(
        table(spark, sf_dir, "node_metrics").select("repo_id", "revision_id", "node_id", "importance", "computed_at"),
        ["repo_id", "node_id"],
        "computed_at",
        [F.col("importance").desc_nulls_last(), F.col("revision_id").desc_nulls_last()],
    ).where("importance is not null and not isnan(importance)")
    of = metrics.select("repo_id", "revision_id").distinct()
    nodes = table(spark, sf_dir, "nodes").select("repo_id", "revision_id", F.col("id").alias("node_id"), "kind", "name", "file_id", "loaded_at")
    nodes = standing(
        join_small(nodes, of, ["repo_id", "revision_id"], "left_semi", salt=["node_id"]),
        ["repo_id", "revision_id", "node_id"],
        "loaded_at",
        [F.col("name").desc_nulls_last(), F.col("kind").desc_nulls_last(), F.col("file_id").desc_nulls_last()],
    ).where("file_id is not null")
    return metrics.drop("computed_at").join(nodes.drop("loaded_at"), ["repo_id", "revision_id", "node_id"])


def p2_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three names of greatest importance for each file and kind, with their position."""
    return top_n(
        measured_nodes(spark, sf_dir).select("repo_id", "file_id", "kind", "node_id", "name", "importance"),
        ["repo_id", "file_id", "kind"],
        [F.col("importance").desc(), F.col("name").asc_nulls_first(), F.col("node_id").asc_nulls_first()],
        3,
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_top(spark, sf_dir).select("repo_id", "node_id")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repo_files").select("repo_id", "file_id", "path", "contents", "scanned_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_files(_files(spark, sf_dir)).where("not valid").select("repo_id", "file_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity_rates(_files(spark, sf_dir), table(spark, sf_dir, "region_languages"))


def p4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All errors of the invalid files, the first cause first, and the languages that accept the text."""
    return check_files(_files(spark, sf_dir)).where("not valid").drop("valid")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_files(_files(spark, sf_dir), table(spark, sf_dir, "repository")).select("repo_id", "file_id")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each kind that weren't written by hand, by extension."""
    return foreign_files(_files(spark, sf_dir), table(spark, sf_dir, "repository")).groupBy("extension", "kind").agg(F.count(F.lit(1)).alias("files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))
    return found.where("verbatim").select("doc_id", "item_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item that leaked: documents with its wording and documents that paraphrase it."""
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(
        F.count_if("verbatim").alias("verbatim"), F.count_if(~F.col("verbatim")).alias("paraphrased"), F.max("run").alias("longest_run")
    )


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).drawn


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "doc_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of the corpus by subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {f.__name__: f for f in (p2_found, p2_top, p4_found, p4_rates, p4_errors, p5_found, p5_kinds, p6_found, p6_report, p7_drawn, p7_shares, p8_found, p8_makeup)}

_RANKED = """
WITH m AS (
  SELECT * FROM node_metrics QUALIFY row_number() OVER (PARTITION BY repo_id, node_id ORDER BY computed_at DESC, importance DESC NULLS LAST) = 1),
n AS (
  SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY repo_id, revision_id, id ORDER BY loaded_at DESC) = 1),
ranked AS (
  SELECT n.repo_id, n.file_id, n.kind, n.id AS node_id, n.name, m.importance,
         row_number() OVER (PARTITION BY n.repo_id, n.file_id, n.kind ORDER BY m.importance DESC, n.name ASC NULLS FIRST, n.id ASC NULLS FIRST) AS position
  FROM m JOIN n ON m.repo_id = n.repo_id AND m.revision_id = n.revision_id AND m.node_id = n.id
  WHERE m.importance IS NOT NULL AND NOT isnan(m.importance) AND n.file_id IS NOT NULL)
"""
#: The words of a text, as a DuckDB list.
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"

SQL = {
    "p2_found": _RANKED + "SELECT repo_id, node_id FROM ranked WHERE position <= 3",
    "p2_top": _RANKED + "SELECT * FROM ranked WHERE position <= 3",
    "p6_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w, least(13, len({_WORDS.format('text')})) AS n FROM eval_items),
dr AS (
  SELECT doc_id, n, array_to_string(w[s : s + n - 1], ' ') AS run
  FROM d, (SELECT DISTINCT n FROM i WHERE n > 0) AS k, unnest(range(1, len(w) - n + 2)) AS t(s)),
ir AS (SELECT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS run FROM i, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE n > 0)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (n, run)""",
}
