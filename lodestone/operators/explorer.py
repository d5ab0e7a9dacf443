"""Packages, hotspots, cycles of all kinds, search, and what reaches what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.health import call_edges, node_metrics
from lodestone.operators.traversal import components, cycles, reach
from lodestone.plans.graph import Graph, is_declaration

#: Most entries of a list (fixed value).
LIST = 100


def package_of(file_id: Column) -> Column:
    """The first two segments of a file's path, or the only one."""
    return F.array_join(F.slice(F.split(F.regexp_replace(file_id, "^file:", ""), "/"), 1, 2), "/")


def _places(graph: Graph) -> DataFrame:
    at = F.when(F.col("kind") == "File", F.col("id")).otherwise(F.col("file_id"))
    return graph.nodes.where(at.isNotNull() & (F.col("kind") != "External")).select("repo_id", "id", "kind", package_of(at).alias("package"))


def package_imports(graph: Graph) -> DataFrame:
    """Imports that cross from one package into another: edges of each ordered pair."""
    places = _places(graph)
    source = places.select("repo_id", F.col("id").alias("source_id"), F.col("package").alias("source"))
    target = places.select("repo_id", F.col("id").alias("target_id"), F.col("package").alias("target"))
    return (
        graph.of_type("IMPORTS")
        .join(source, ["repo_id", "source_id"])
        .join(target, ["repo_id", "target_id"])
        .where("source != target")
        .groupBy("repo_id", "source", "target")
        .agg(F.count(F.lit(1)).alias("imports"))
    )


def packages(graph: Graph) -> DataFrame:
    """Files, declarations, and packages depended on and depending, of every package."""
    sizes = _places(graph).groupBy("repo_id", "package").agg(F.count_if(F.col("kind") == "File").alias("files"), F.count_if(is_declaration()).alias("declarations"))
    crossing = package_imports(graph)
    needs = crossing.groupBy("repo_id", F.col("source").alias("package")).agg(F.count(F.lit(1)).alias("dependencies"))
    needed = crossing.groupBy("repo_id", F.col("target").alias("package")).agg(F.count(F.lit(1)).alias("dependents"))
    return sizes.join(needs, ["repo_id", "package"], "left").join(needed, ["repo_id", "package"], "left").fillna(0)


def files(graph: Graph) -> DataFrame:
    """For every file: declarations, imports of files and of externals, environment variables read, edges out and in."""
    at = F.when(F.col("kind") == "File", F.col("id")).otherwise(F.col("file_id"))
    places = graph.nodes.where(at.isNotNull()).select("repo_id", F.col("id").alias("source_id"), at.alias("id"))
    kinds = graph.nodes.select("repo_id", F.col("id").alias("target_id"), F.col("kind").alias("target_kind"))
    out = (
        graph.edges.join(places, ["repo_id", "source_id"])
        .drop(graph.edges["id"])
        .join(kinds, ["repo_id", "target_id"], "left")
        .groupBy("repo_id", places["id"])
        .agg(
            F.count(F.lit(1)).alias("edges"),
            F.count_if((F.col("type") == "IMPORTS") & (F.col("target_kind") == "File")).alias("file_imports"),
            F.count_if((F.col("type") == "IMPORTS") & (F.col("target_kind") == "External")).alias("external_imports"),
            F.countDistinct(F.when(F.col("type") == "READS", F.col("target_id"))).alias("variables"),
        )
    )
    counted = graph.nodes.where(is_declaration()).groupBy("repo_id", F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("declarations"))
    base = graph.of_kind("File").select("repo_id", "id")
    return base.join(out, ["repo_id", "id"], "left").join(counted, ["repo_id", "id"], "left").fillna(0)


#: Relationships of each kind of cycle; the import cycles are those of the module projection.
CYCLES = {"call": ["CALLS"], "reference": ["REFERENCES_TYPE"], "inheritance": ["EXTENDS", "IMPLEMENTS"]}


def all_cycles(graph: Graph) -> DataFrame:
    """Cycles of imports, calls, type references and inheritance: (repo_id, graph, cycle, size)."""
    parts = []
    for name, types in (("import", None), *CYCLES.items()):
        edges = graph.module_edges() if types is None else call_edges(graph) if name == "call" else graph.of_type(*types)
        parts.append(cycles(edges).groupBy("repo_id", F.lit(name).alias("graph"), "cycle").agg(F.count(F.lit(1)).alias("size")))
    return reduce(DataFrame.unionByName, parts)


def hotspots(graph: Graph, most: int = LIST) -> DataFrame:
    """Lists of declarations by edges in, by edges both ways, by fan-in and fan-out, and of files by edges; ties by id."""
    m = node_metrics(graph)
    decl, own = m.where(is_declaration()), m.where("kind = 'File'")
    both = F.col("incoming_edges") + F.col("outgoing_edges")
    lists = [("referenced", decl, F.col("incoming_edges")), ("coupled", decl, both), ("fan-in", decl, F.col("fan_in")), ("fan-out", decl, F.col("fan_out")), ("files", own, both)]
    union = reduce(DataFrame.unionByName, [df.select("repo_id", "id", F.lit(n).alias("list"), v.alias("value")) for n, df, v in lists]).where("value > 0")
    order = Window.partitionBy("repo_id", "list").orderBy(F.col("value").desc(), "id")
    ranked = union.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    total = union.groupBy("repo_id", "list").agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(total, ["repo_id", "list"])


def hubs(graph: Graph) -> DataFrame:
    """The declaration of greatest fan-in of each repository, the least id among equals."""
    m = node_metrics(graph).where(is_declaration())
    return m.groupBy("repo_id").agg(F.min(F.struct((-F.col("fan_in")).alias("fan"), "id")).alias("best")).select("repo_id", F.col("best.id").alias("id"))


def forward(graph: Graph, roots: DataFrame) -> DataFrame:
    """What roots depend on, over coupled pairs."""
    return reach(graph.coupling, roots)


def backward(graph: Graph, roots: DataFrame) -> DataFrame:
    """What depends on roots, over coupled pairs."""
    return reach(graph.coupling.select("repo_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), roots)


def clusters(graph: Graph) -> DataFrame:
    """Size of the weak component of every coupled node."""
    parts = components(graph.coupling)
    return parts.join(parts.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("size")), ["repo_id", "component"])


#: Groups of results of a search, by kind.
GROUPS = {
    "declarations": None,
    "files": ["File"],
    "routes": ["Route"],
    "environment": ["EnvironmentVariable"],
    "externals": ["External"],
    "technologies": ["Technology"],
    "dependencies": ["Dependency", "Manifest"],
    "artifacts": ["ArtifactElement"],
}


def search(graph: Graph, text: str, *, exact: bool = False, kind: str | None = None, most: int = LIST) -> DataFrame:
    """Nodes whose name or id is, or begins with, ``text`` (with case); an empty text without a kind finds nothing.

    Result: repo_id, group, id, position (by id) and total of the group; at most ``most`` of each group and repository.
    """
    if not text and kind is None:
        return graph.nodes.limit(0).select("repo_id", F.lit("").alias("group"), "id", F.lit(0).alias("position"), F.lit(0).cast("bigint").alias("total"))
    match = (F.col("name") == text) | (F.col("id") == text) if exact else F.col("name").startswith(text) | F.col("id").startswith(text)
    found = graph.nodes.where(match if text else F.lit(True))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    group = F.lit("other")
    for name, kinds in GROUPS.items():
        group = F.when(is_declaration() if kinds is None else F.col("kind").isin(*kinds), name).otherwise(group)
    part = Window.partitionBy("repo_id", "group")
    return (
        found.select("repo_id", group.alias("group"), "id")
        .withColumn("position", F.row_number().over(part.orderBy("id")))
        .withColumn("total", F.count(F.lit(1)).over(part))
        .where(F.col("position") <= most)
    )


def artifact_inventory(graph: Graph) -> DataFrame:
    """Files and elements of every kind of artefact, with three examples by path."""
    elements = graph.of_kind("ArtifactElement").where("file_id is not null")
    counted = elements.groupBy("repo_id", "artifact_kind").agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("elements"))
    order = Window.partitionBy("repo_id", "artifact_kind").orderBy("file_id")
    few = elements.select("repo_id", "artifact_kind", "file_id").distinct().withColumn("r", F.row_number().over(order)).where("r <= 3")
    examples = few.groupBy("repo_id", "artifact_kind").agg(F.array_join(F.array_sort(F.collect_list("file_id")), ", ").alias("examples"))
    return counted.join(examples, ["repo_id", "artifact_kind"])
