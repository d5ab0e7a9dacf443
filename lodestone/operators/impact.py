"""What a change of a declaration affects: the closure of its dependents, with the routes, variables and packages in it."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import DECLARATIONS
from lodestone.operators.traversal import LOCAL_EDGES
from lodestone.plans.graph import Graph
from lodestone.plans.staging import join_small, ship, stage

#: Dependents of these kinds have dependents of their own; others are recorded and not followed.
EXPANDABLE = ["File", *DECLARATIONS]


#: Targets of one repository up to which they are searched for inside one task.
LOCAL_TARGETS = 8
FOUND = "repo_id bigint, target_id string, source_id string, kind string, depth int, via string, rank bigint"


def _local_dependents(most: int | None):
    def run(targets: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        into: dict[str, list[tuple[str, str, str]]] = {}
        ordered = edges.sort_values("edge_id", kind="stable")
        for at, source, edge, kind in zip(ordered["at"], ordered["source_id"], ordered["edge_id"], ordered["kind"]):
            into.setdefault(at, []).append((source, edge, kind))
        rows = []
        for target in targets["target_id"]:
            seen, frontier, depth = {target}, [target], 0
            while frontier and (most is None or depth < most):
                depth += 1
                new, rank = [], 0
                for at in frontier:
                    for source, edge, kind in into.get(at, ()):
                        if source not in seen:
                            seen.add(source)
                            rank += 1
                            rows.append((target, source, kind, depth, edge, rank))
                            if kind in EXPANDABLE:
                                new.append(source)
                frontier = new
        out = pd.DataFrame(rows, columns=["target_id", "source_id", "kind", "depth", "via", "rank"]).astype({"depth": "int32", "rank": "int64"})
        out.insert(0, "repo_id", pd.Series([targets["repo_id"].iloc[0] if len(targets) else 0] * len(out), dtype="int64"))
        return out

    return run


def dependents(graph: Graph, targets: DataFrame, most: int | None = None, local: int = LOCAL_EDGES) -> DataFrame:
    """The dependents of each target (repo_id, id): breadth first over incoming edges but DECLARES.

    Result: repo_id, target_id, id, kind, depth, via (the edge it was first found by), reach (DIRECT or INDIRECT). A node is
    found by the edge whose end was discovered first, then by the least edge id, as a search in edge order would. Routes
    are left to ``routes_affected``; targets that aren't nodes have no dependents. Cycles end by themselves. A repository of
    at most ``local`` edges and ``LOCAL_TARGETS`` targets is searched inside one task, others level by level over all.
    """
    ship(graph.nodes.sparkSession)
    kinds = graph.nodes.select("repo_id", F.col("id").alias("source_id"), "kind")
    ways = stage(
        graph.edges.where("type != 'DECLARES'")
        .select("repo_id", F.col("target_id").alias("at"), "source_id", F.col("id").alias("edge_id"))
        .join(kinds, ["repo_id", "source_id"])
    )
    ways = ways.where("kind != 'Route'")
    start = stage(targets.select("repo_id", F.col("id").alias("target_id")).where("repo_id is not null and id is not null").distinct())
    many = ways.groupBy("repo_id").count().where(F.col("count") > local).select("repo_id")
    often = start.groupBy("repo_id").count().where(F.col("count") > LOCAL_TARGETS).select("repo_id")
    large = stage(many.unionByName(often).distinct())
    near = join_small(start, large, ["repo_id"], "left_anti", salt=["target_id"])
    inner = near.groupBy("repo_id").cogroup(join_small(ways, large, ["repo_id"], "left_anti", salt=["edge_id"]).groupBy("repo_id"))
    parts = [inner.applyInPandas(_local_dependents(most), FOUND)]
    start = stage(join_small(start, large, ["repo_id"], "left_semi", salt=["target_id"]))
    frontier = start.select("repo_id", "target_id", F.col("target_id").alias("at"), F.lit(1).cast("bigint").alias("rank"))
    seen = start.select("repo_id", "target_id", F.col("target_id").alias("source_id"))
    depth = 0
    while start.limit(1).count() and (most is None or depth < most):
        depth += 1
        met = frontier.join(ways, ["repo_id", "at"]).join(seen, ["repo_id", "target_id", "source_id"], "left_anti")
        first = met.groupBy("repo_id", "target_id", "source_id", "kind").agg(F.min(F.struct("rank", "edge_id")).alias("found"))
        order = Window.partitionBy("repo_id", "target_id").orderBy("found")
        new = stage(
            first.select(
                "repo_id", "target_id", "source_id", "kind", F.lit(depth).alias("depth"), F.col("found.edge_id").alias("via"), F.row_number().over(order).cast("bigint").alias("rank")
            )
        )
        if not new.limit(1).count():
            break
        parts.append(new)
        seen = seen.unionByName(new.select("repo_id", "target_id", "source_id"))
        frontier = new.where(F.col("kind").isin(*EXPANDABLE)).select("repo_id", "target_id", F.col("source_id").alias("at"), "rank")
    found = reduce(DataFrame.unionByName, parts)
    return found.select(
        "repo_id", "target_id", F.col("source_id").alias("id"), "kind", "depth", "via", F.when(F.col("depth") == 1, "DIRECT").otherwise("INDIRECT").alias("reach")
    )


def members(found: DataFrame, targets: DataFrame) -> DataFrame:
    """The closure with its targets."""
    own = targets.select("repo_id", F.col("id").alias("target_id"), "id").distinct()
    return found.select("repo_id", "target_id", "id").unionByName(own)


def routes_affected(graph: Graph, found: DataFrame, targets: DataFrame) -> DataFrame:
    """Every (route, node of the closure, edge)."""
    routes = graph.of_kind("Route").select("repo_id", F.col("id").alias("source_id"))
    edges = graph.edges.where("type != 'DECLARES'").join(routes, ["repo_id", "source_id"], "left_semi")
    edges = edges.select("repo_id", F.col("source_id").alias("route_id"), F.col("target_id").alias("id"), F.col("id").alias("edge_id"))
    return members(found, targets).join(edges, ["repo_id", "id"]).select("repo_id", "target_id", "route_id", "id", "edge_id")


def environment_affected(graph: Graph, found: DataFrame, targets: DataFrame) -> DataFrame:
    reads = graph.of_type("READS").select("repo_id", F.col("source_id").alias("id"), F.col("target_id").alias("variable_id"))
    return members(found, targets).join(reads, ["repo_id", "id"]).select("repo_id", "target_id", "variable_id").distinct()


def externals_affected(graph: Graph, found: DataFrame, targets: DataFrame) -> DataFrame:
    """Externals that the files of the closure import: files of its declarations, and its files."""
    place = graph.nodes.select("repo_id", "id", F.when(F.col("kind") == "File", F.col("id")).otherwise(F.col("file_id")).alias("file_id"))
    files = members(found, targets).join(place, ["repo_id", "id"]).where("file_id is not null").select("repo_id", "target_id", "file_id").distinct()
    externals = graph.of_kind("External").select("repo_id", F.col("id").alias("external_id"))
    imports = graph.of_type("IMPORTS").select("repo_id", F.col("source_id").alias("file_id"), F.col("target_id").alias("external_id")).distinct()
    return files.join(imports.join(externals, ["repo_id", "external_id"], "left_semi"), ["repo_id", "file_id"]).select("repo_id", "target_id", "external_id").distinct()


def statistics(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Affected nodes, direct ones and the greatest depth of every target."""
    counted = found.groupBy("repo_id", "target_id").agg(
        F.count(F.lit(1)).alias("affected"), F.count_if(F.col("depth") == 1).alias("direct"), F.max("depth").alias("depth")
    )
    return targets.select("repo_id", F.col("id").alias("target_id")).distinct().join(counted, ["repo_id", "target_id"], "left").fillna(0)
