"""Point lookups and one-step questions about nodes, asked for all nodes of all repositories at once.

Each returns flat rows, so that a caller filters on an id to get the answer for one node. Hydration is a left join: an
edge whose other end isn't a node stays, with nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.graph import Graph, is_declaration

#: A route's id: method and path part at the first two colons.
ROUTE = r"^route:([^:]+):(.+)$"


def _end(graph: Graph, end: str) -> DataFrame:
    return graph.nodes.select("repo_id", F.col("id").alias(f"{end}_id"), F.col("kind").alias(f"{end}_kind"), F.col("name").alias(f"{end}_name"))


def node(graph: Graph, node_id: str) -> DataFrame:
    """The node of an id in each repository that has it."""
    return graph.nodes.where(F.col("id") == node_id)


def outgoing(graph: Graph, node_id: str, kind: str | None = None) -> DataFrame:
    found = graph.edges.where(F.col("source_id") == node_id)
    return (found if kind is None else found.where(F.col("type") == kind)).orderBy("repo_id", "id")


def incoming(graph: Graph, node_id: str, kind: str | None = None) -> DataFrame:
    found = graph.edges.where(F.col("target_id") == node_id)
    return (found if kind is None else found.where(F.col("type") == kind)).orderBy("repo_id", "id")


def declarations(graph: Graph) -> DataFrame:
    return graph.nodes.where(is_declaration()).select("repo_id", "id", "kind", "name", "file_id")


def enclosing(graph: Graph) -> DataFrame:
    """The declaration that each declaration lies in; a file doesn't count."""
    source = _end(graph, "source").where(is_declaration("source_kind"))
    return (
        graph.of_type("DECLARES")
        .join(source, ["repo_id", "source_id"])
        .select("repo_id", F.col("target_id").alias("id"), F.col("source_id").alias("enclosing_id"), F.col("source_kind").alias("enclosing_kind"))
    )


def references(graph: Graph) -> DataFrame:
    """All incoming edges but DECLARES, with the node they come from."""
    return (
        graph.edges.where("type != 'DECLARES'")
        .join(_end(graph, "source"), ["repo_id", "source_id"], "left")
        .select("repo_id", F.col("target_id").alias("id"), F.col("id").alias("edge_id"), "type", "source_id", "source_kind", "source_name")
    )


def type_references(graph: Graph) -> DataFrame:
    return references(Graph(graph.nodes, graph.of_type("REFERENCES_TYPE"))).drop("type")


def callers(graph: Graph) -> DataFrame:
    """Who calls each node: one row per call."""
    return references(Graph(graph.nodes, graph.of_type("CALLS"))).drop("type")


def callees(graph: Graph) -> DataFrame:
    """What each node calls: one row per call."""
    return (
        graph.of_type("CALLS")
        .join(_end(graph, "target"), ["repo_id", "target_id"], "left")
        .select("repo_id", F.col("source_id").alias("id"), F.col("id").alias("edge_id"), "target_id", "target_kind", "target_name", "confidence")
    )


def routes(graph: Graph) -> DataFrame:
    """Routes with method, path and the chain of their handlers by ordinal (none counts as 0), then edge id."""
    chain = (
        graph.of_type("HANDLED_BY")
        .groupBy("repo_id", F.col("source_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.col("id").alias("edge_id"), "target_id"))).alias("chain"))
    )
    handlers = F.transform("chain", lambda x: x["target_id"])
    return (
        graph.of_kind("Route")
        .join(chain, ["repo_id", "id"], "left")
        .select(
            "repo_id",
            "id",
            F.regexp_extract("id", ROUTE, 1).alias("method"),
            F.regexp_extract("id", ROUTE, 2).alias("path"),
            F.when(F.size("chain") > 0, F.element_at(handlers, -1)).alias("handler"),
            F.coalesce(F.when(F.size("chain") > 1, F.slice(handlers, 1, F.size("chain") - 1)), F.array().cast("array<string>")).alias("middleware"),
        )
    )


def environment_variables(graph: Graph) -> DataFrame:
    """Variables with the nodes that read them; one row with a null reader where none does."""
    reads = graph.of_type("READS").select("repo_id", F.col("target_id").alias("id"), F.col("source_id").alias("reader"), F.col("id").alias("edge_id"))
    return graph.of_kind("EnvironmentVariable").select("repo_id", "id", "name").join(reads, ["repo_id", "id"], "left")


def dependencies(graph: Graph) -> DataFrame:
    """Externals with the nodes that import them; one row with a null importer where none does."""
    reads = graph.of_type("IMPORTS").select("repo_id", F.col("target_id").alias("id"), F.col("source_id").alias("importer"), F.col("id").alias("edge_id"))
    return graph.of_kind("External").select("repo_id", "id", "external_kind", "external_name").join(reads, ["repo_id", "id"], "left")


def technologies(graph: Graph) -> DataFrame:
    """Technologies by region."""
    return graph.of_kind("Technology").select("repo_id", F.col("container_chain").alias("region"), "name", "id", "category", "confidence")


def by_role(graph: Graph, roles: DataFrame, role: str) -> DataFrame:
    """Classes, functions and variables that carry a role (repo_id, node_id, role); classes first, then functions."""
    carries = roles.where(F.col("role") == role).select("repo_id", F.col("node_id").alias("id")).distinct()
    kinds = ["Class", "Function", "Variable"]
    return (
        graph.of_kind(*kinds)
        .join(carries, ["repo_id", "id"], "left_semi")
        .select("repo_id", "id", "kind", F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).alias("place"))
    )


def explain(graph: Graph) -> DataFrame:
    """One row for each declaration: counts of references, calls, type references, callees, reads, and its file's imports."""
    refs = references(graph)
    calls = graph.of_type("CALLS")

    def count(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy("repo_id", F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(name))

    out = declarations(graph)
    for df, key, at, name in (
        (refs, "id", "id", "references"),
        (refs.where("type = 'CALLS'"), "id", "id", "callers"),
        (refs.where("type = 'REFERENCES_TYPE'"), "id", "id", "type_references"),
        (calls, "source_id", "id", "callees"),
        (graph.of_type("READS"), "source_id", "id", "environment_reads"),
        (graph.of_type("IMPORTS"), "source_id", "file_id", "file_imports"),
    ):
        counted = count(df, key, name).withColumnRenamed("key", at)
        out = out.join(counted, ["repo_id", at], "left")
    names = ["references", "callers", "type_references", "callees", "environment_reads", "file_imports"]
    return out.fillna(0, names).select("repo_id", "id", "kind", *names)


def reaching_routes(graph: Graph) -> DataFrame:
    """Routes whose chain holds a declaration, and whether it is the handler (the last) or middleware."""
    last = Window.partitionBy("repo_id", "source_id").orderBy(F.coalesce("ordinal", F.lit(0)).desc(), F.col("id").desc())
    return (
        graph.of_type("HANDLED_BY")
        .withColumn("position", F.when(F.row_number().over(last) == 1, "handler").otherwise("middleware"))
        .select("repo_id", F.col("target_id").alias("id"), F.col("source_id").alias("route_id"), "position")
    )


