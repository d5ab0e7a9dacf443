"""The property graph of many repositories: standing nodes and edges of the latest delivered revision of each."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.values import bare
from lodestone.functions.vocabulary import CONFIDENCES, COUPLING, DECLARATIONS
from lodestone.plans.staging import join_small, stage
from lodestone.plans.standing import standing
from lodestone.sources.tables import state, table


def is_declaration(kind: str | Column = "kind") -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).isin(*DECLARATIONS)


def confidence_rank(confidence: Column) -> Column:
    """0 for the strongest; unknown words come last."""
    out = F.lit(len(CONFIDENCES))
    for i, c in enumerate(CONFIDENCES):
        out = F.when(confidence == c, i).otherwise(out)
    return out


@dataclass
class Graph:
    """nodes: repo_id, id, kind and the other attributes. edges: repo_id, id, type, source_id, target_id and the others."""

    nodes: DataFrame
    edges: DataFrame

    def of_type(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds))

    @cached_property
    def coupling(self) -> DataFrame:
        """Distinct pairs of coupled nodes."""
        return self.of_type(*COUPLING).select("repo_id", "source_id", "target_id").distinct()

    def module_edges(self) -> DataFrame:
        """Imports between files: from the file of the importing node to the file of the imported one, without externals and itself."""
        place = self.nodes.select(
            "repo_id", F.col("id").alias("node_id"), F.when(F.col("kind") == "File", F.col("id")).otherwise(F.col("file_id")).alias("at"), "kind"
        )
        source = place.where("at is not null").select("repo_id", F.col("node_id").alias("source_id"), F.col("at").alias("source_file"))
        target = place.where("kind != 'External' and at is not null").select("repo_id", F.col("node_id").alias("target_id"), F.col("at").alias("target_file"))
        return (
            self.of_type("IMPORTS")
            .select("repo_id", "source_id", "target_id")
            .distinct()
            .join(source, ["repo_id", "source_id"])
            .join(target, ["repo_id", "target_id"])
            .where("source_file != target_file")
            .select("repo_id", F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id"))
            .distinct()
        )


def standing_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Edges are delivered more than once and with blanks around targets; of nodes the row with the greatest loaded_at stands."""
    edges = (
        table(spark, sf_dir, "edges")
        .select(
            "repo_id",
            "revision_id",
            "id",
            "type",
            "source_id",
            bare(F.col("target_id")).alias("target_id"),
            "name",
            "confidence",
            "candidate_group",
            "ordinal",
            F.col("provenance.producer").alias("producer"),
            F.col("provenance.file_id").alias("provenance_file"),
            F.col("location.start_line").alias("line"),
            F.col("location.start_column").alias("col"),
        )
        .distinct()
    )
    covered = table(spark, sf_dir, "edges").select("repo_id", "revision_id").distinct()
    nodes = standing(
        join_small(table(spark, sf_dir, "nodes"), covered, ["repo_id", "revision_id"], "left_semi", salt=["id"]),
        ["repo_id", "revision_id", "id"],
        "loaded_at",
        [F.col("kind").desc_nulls_last(), F.col("name").desc_nulls_last(), F.col("file_id").desc_nulls_last()],
    )
    return Graph(nodes, edges)


_STAGED: dict[tuple, Graph] = {}


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The standing graph, staged once for a session and a state of the tables, so that queries read what they need of it.

    A state is told by the size and time of ``nodes`` and ``edges``; a table that is delivered anew is staged anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, *[state(spark, sf_dir, t) for t in ("nodes", "edges")])
    if key not in _STAGED:
        graph = standing_graph(spark, sf_dir)
        _STAGED[key] = Graph(stage(graph.nodes), stage(graph.edges))
    return _STAGED[key]


#: The same graph in DuckDB: g_edges and g_nodes.
GRAPH_SQL = """
WITH g_edges AS (
  SELECT DISTINCT repo_id, revision_id, id, type, source_id, regexp_replace(target_id, '^\\s+|\\s+$', '', 'g') AS target_id, name, confidence, candidate_group, ordinal,
         provenance.producer AS producer, provenance.file_id AS provenance_file, location.start_line AS line, location.start_column AS col
  FROM edges),
g_nodes AS (
  SELECT n.* FROM (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY repo_id, revision_id, id ORDER BY loaded_at DESC) = 1) n
  JOIN (SELECT DISTINCT repo_id, revision_id FROM edges) USING (repo_id, revision_id))
"""


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: Coupled pairs and declaration kinds in SQL.
COUPLING_SQL = f"coupling AS (SELECT DISTINCT repo_id, source_id, target_id FROM g_edges WHERE type IN {in_list(COUPLING)})"
MODULE_SQL = """place AS (SELECT repo_id, id, kind, CASE WHEN kind = 'File' THEN id ELSE file_id END AS at FROM g_nodes),
modules AS (
  SELECT DISTINCT e.repo_id, s.at AS source_id, t.at AS target_id FROM g_edges e
  JOIN place s ON s.repo_id = e.repo_id AND s.id = e.source_id JOIN place t ON t.repo_id = e.repo_id AND t.id = e.target_id
  WHERE e.type = 'IMPORTS' AND t.kind <> 'External' AND s.at IS NOT NULL AND t.at IS NOT NULL AND s.at <> t.at)"""
