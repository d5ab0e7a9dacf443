"""Trees of a repository and reach from groups of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.explorer import package_imports, package_of
from lodestone.operators.traversal import levels, reach
from lodestone.plans.graph import Graph, is_declaration


def tree(graph: Graph) -> DataFrame:
    """Package, file and declaration of everything declared, with the kinds of each file counted."""
    decl = graph.nodes.where(is_declaration() & F.col("file_id").isNotNull())
    return decl.groupBy("repo_id", package_of(F.col("file_id")).alias("package"), "file_id", "kind").agg(F.count(F.lit(1)).alias("declarations"))


def group_reach(graph: Graph, groups: DataFrame, backward: bool = False) -> DataFrame:
    """What each group (repo_id, group, id) reaches over coupled pairs, outside itself, at the least depth."""
    edges = graph.coupling
    if backward:
        edges = edges.select("repo_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return reach(edges, groups.select("repo_id", "group", "id"), group=["group"]).where("depth > 0")


def largest_packages(graph: Graph) -> DataFrame:
    """The members of the package with the most declarations in each repository, the least name among equals."""
    places = graph.nodes.where(is_declaration() & F.col("file_id").isNotNull()).select("repo_id", "id", package_of(F.col("file_id")).alias("group"))
    sizes = places.groupBy("repo_id", "group").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("repo_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "group")).alias("b")).select("repo_id", F.col("b.group").alias("group"))
    return places.join(best, ["repo_id", "group"], "left_semi")


def package_levels(graph: Graph) -> DataFrame:
    """Topological level of every package under its imports; null on or behind a cycle."""
    crossing = package_imports(graph)
    edges = crossing.select("repo_id", F.col("source").alias("source_id"), F.col("target").alias("target_id"))
    nodes = edges.select("repo_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    return levels(nodes, edges).withColumnRenamed("id", "package")


def explain_routes(graph: Graph) -> DataFrame:
    """For every route: handlers, and nodes, variables and packages that its handlers reach over coupled pairs."""
    handlers = graph.of_type("HANDLED_BY").select("repo_id", F.col("source_id").alias("group"), F.col("target_id").alias("id")).distinct()
    found = reach(graph.coupling, handlers, group=["group"])
    kinds = graph.nodes.select("repo_id", "id", "kind")
    return found.join(kinds, ["repo_id", "id"]).groupBy("repo_id", F.col("group").alias("route_id")).agg(
        F.count_if(F.col("depth") == 0).alias("handlers"),
        F.count_if(F.col("depth") > 0).alias("reached"),
        F.count_if(F.col("kind") == "EnvironmentVariable").alias("variables"),
        F.count_if(F.col("kind") == "External").alias("externals"),
        F.max("depth").alias("depth"),
    )
