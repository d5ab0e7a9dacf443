"""What one looks at of a repository, a package, a file or a declaration: one row each, with nested lists.

A list holds the first ``LIST`` entries in binary order beside the number of all. The entries of a hub are cut before they
are shuffled, so that no list is gathered whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import CONFIDENCES
from lodestone.operators.explorer import LIST, package_imports, package_of
from lodestone.plans.graph import Graph, is_declaration


def listed(entries: DataFrame, key: list[str], name: str, most: int = LIST) -> DataFrame:
    """For each key the first ``most`` distinct ``entry`` values as an array ``name``, and ``n_`` + name, how many there are."""
    distinct = entries.where("entry is not null").select(*key, "entry").distinct()
    first = distinct.withColumn("__ls_r", F.row_number().over(Window.partitionBy(*key).orderBy("entry"))).where(F.col("__ls_r") <= most)
    heads = first.groupBy(*key).agg(F.array_sort(F.collect_list("entry")).alias(name))
    return distinct.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}")).join(heads, key)


def _beside(base: DataFrame, key: list[str], lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """``base`` with the lists of its keys; empty ones where a key has none."""
    out = reduce(lambda df, part: df.join(listed(part[1], key, part[0]), key, "left"), lists, base)
    none = F.array().cast("array<string>")
    return out.select(*base.columns, *[x for n, _ in lists for x in (F.coalesce(f"n_{n}", F.lit(0).cast("bigint")).alias(f"n_{n}"), F.coalesce(n, none).alias(n))])


def _ways(graph: Graph, kind: str, at: str, entry: str) -> DataFrame:
    return graph.of_type(kind).select("repo_id", F.col(at).alias("id"), F.col(entry).alias("entry"))


def symbols(graph: Graph) -> DataFrame:
    """Every declaration with its parent, members, callers, callees, all that refer to it, and the variables it reads.

    References are incoming edges of any kind but DECLARES and CONTAINS. A declaration without a DECLARES edge to it has a
    null parent; of several parents the least id is given.
    """
    parents = graph.of_type("DECLARES").groupBy("repo_id", F.col("target_id").alias("id")).agg(F.min("source_id").alias("parent_id"))
    base = graph.nodes.where(is_declaration()).select("repo_id", "id", "kind", "name", "file_id").join(parents, ["repo_id", "id"], "left")
    lists = [
        ("members", _ways(graph, "DECLARES", "source_id", "target_id")),
        ("callers", _ways(graph, "CALLS", "target_id", "source_id")),
        ("callees", _ways(graph, "CALLS", "source_id", "target_id")),
        ("referrers", graph.edges.where("type not in ('DECLARES', 'CONTAINS')").select("repo_id", F.col("target_id").alias("id"), F.col("source_id").alias("entry"))),
        ("variables", _ways(graph, "READS", "source_id", "target_id")),
    ]
    return _beside(base, ["repo_id", "id"], lists)


def files(graph: Graph) -> DataFrame:
    """Every file with its package, declarations, what it imports and exports, and the files whose nodes import it or a node in it."""
    base = graph.of_kind("File").select("repo_id", "id", package_of(F.col("id")).alias("package"))
    within = graph.nodes.where(is_declaration()).select("repo_id", F.col("file_id").alias("id"), F.col("id").alias("entry"))
    importers = graph.module_edges().select("repo_id", F.col("target_id").alias("id"), F.col("source_id").alias("entry"))
    lists = [
        ("declarations", within),
        ("imports", _ways(graph, "IMPORTS", "source_id", "target_id")),
        ("exports", _ways(graph, "EXPORTS", "source_id", "target_id")),
        ("importers", importers),
    ]
    return _beside(base, ["repo_id", "id"], lists)


def packages(graph: Graph) -> DataFrame:
    """Every package that has a file, with its files, exported declarations, and the packages it imports from and is imported by."""
    placed = graph.nodes.select("repo_id", "id", "kind", "is_exported", package_of(F.when(F.col("kind") == "File", F.col("id")).otherwise(F.col("file_id"))).alias("package"))
    inside = placed.where("kind = 'File'").select("repo_id", "package", F.col("id").alias("entry"))
    public = placed.where(is_declaration() & F.col("is_exported")).select("repo_id", "package", F.col("id").alias("entry"))
    crossing = package_imports(graph)
    lists = [
        ("files", inside),
        ("exported", public),
        ("needs", crossing.select("repo_id", F.col("source").alias("package"), F.col("target").alias("entry"))),
        ("needed_by", crossing.select("repo_id", F.col("target").alias("package"), F.col("source").alias("entry"))),
    ]
    return _beside(inside.select("repo_id", "package").distinct(), ["repo_id", "package"], lists)


def overview(graph: Graph) -> DataFrame:
    """One row for each repository with a node: nodes by sort, files and edges, and edges by confidence."""
    sorts = {"files": "File", "routes": "Route", "variables": "EnvironmentVariable", "externals": "External", "technologies": "Technology", "dependencies": "Dependency"}
    nodes = graph.nodes.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(is_declaration()).alias("declarations"), *[F.count_if(F.col("kind") == k).alias(n) for n, k in sorts.items()]
    )
    edges = graph.edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in CONFIDENCES])
    return nodes.join(edges, "repo_id", "left").fillna(0)


def neighbours(graph: Graph) -> DataFrame:
    """Every node with the number of its edges out and in by type, as rows (repo_id, id, type, outgoing, incoming); nodes without edges have none."""
    out = graph.edges.select("repo_id", F.col("source_id").alias("id"), "type", F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = graph.edges.select("repo_id", F.col("target_id").alias("id"), "type", F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("repo_id", "id", "type").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
