"""Building graphs from facts: identities, parents, externals, route links, deduplication and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import CONFIDENCES, ENDPOINTS
from lodestone.plans.graph import Graph, confidence_rank, is_declaration


# --- identities ---
def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def declaration_id(path: Column, chain: Column) -> Column:
    """Null where a segment of the chain has a dot."""
    good = ~F.exists(chain, lambda s: s.contains("."))
    return F.when(good, F.concat(F.lit("sym:"), path, F.lit("#"), F.array_join(chain, ".")))


def env_id(name: Column) -> Column:
    clean = F.trim(name)
    return F.when(clean.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("env:"), clean))


def route_id(method: Column, path: Column) -> Column:
    """Slashes are collapsed and a trailing one removed; null where the path doesn't begin with one."""
    once = F.regexp_replace(path, "/+", "/")
    clean = F.when(F.length(once) > 1, F.regexp_replace(once, "/$", "")).otherwise(once)
    return F.when(path.startswith("/"), F.concat(F.lit("route:"), F.upper(method), F.lit(":"), clean))


def external_id(kind: Column, name: Column) -> Column:
    return F.when(_text(name) == "", F.concat(F.lit("ext:"), kind)).otherwise(F.concat(F.lit("ext:"), kind, F.lit(":"), name))


def edge_id(kind: Column, source: Column, target: Column, name: Column, file: Column, line: Column, col: Column) -> Column:
    """Nulls hold their place."""
    return F.concat(F.lit("edge:"), F.concat_ws("|", *[_text(c) for c in (kind, source, target, name, file)], F.concat(_text(line), F.lit(":"), _text(col))))


# --- parents ---
def declares(graph: Graph) -> DataFrame:
    """The parent of each declaration: that of the longest proper prefix of its chain in its file, else the file."""
    decl = graph.nodes.where(is_declaration() & F.col("file_id").isNotNull())
    chain = F.split(F.coalesce("container_chain", "name"), r"\.")
    own = decl.select("repo_id", "id", "file_id", chain.alias("chain"))
    prefixes = own.where(F.size("chain") > 1).select(
        "repo_id", "id", "file_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda n: F.array_join(F.slice("chain", 1, n), "."))).alias("depth", "prefix")
    )
    named = own.select("repo_id", "file_id", F.array_join("chain", ".").alias("prefix"), F.col("id").alias("parent_id"))
    named = named.groupBy("repo_id", "file_id", "prefix").agg(F.min("parent_id").alias("parent_id"))
    found = prefixes.join(named, ["repo_id", "file_id", "prefix"]).groupBy("repo_id", "id").agg(F.max_by("parent_id", "depth").alias("parent_id"))
    return own.join(found, ["repo_id", "id"], "left").select("repo_id", "id", F.coalesce("parent_id", "file_id").alias("parent_id"))


def minted_externals(edges: DataFrame) -> DataFrame:
    """Externals that edges introduce, with the strongest confidence and the number of edges."""
    return (
        edges.where("target_id like 'ext:%'")
        .groupBy("repo_id", F.col("target_id").alias("id"))
        .agg(F.min(confidence_rank(F.col("confidence"))).alias("rank"), F.count(F.lit(1)).alias("edges"))
        .select("repo_id", "id", F.element_at(F.array(*[F.lit(c) for c in CONFIDENCES]), F.col("rank") + 1).alias("confidence"), "edges")
    )


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit arrival order."""
    return df.withColumn("__ls_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__ls_r = 1").drop("__ls_r")


def pooled_dependencies(declared: DataFrame) -> DataFrame:
    """One dependency for each ecosystem and name of (repo_id, manifest, seq, ecosystem, name); the first manifest gives its origin."""
    pooled = declared.groupBy("repo_id", "ecosystem", "name").agg(F.min_by("manifest", "seq").alias("manifest"), F.countDistinct("manifest").alias("manifests"))
    return pooled.withColumn("id", F.concat(F.lit("dep:"), "ecosystem", F.lit(":"), "name"))


# --- routes ---
PARAMETER = r"^(:.*|\{.*\}|<.*>|\d+|(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"


def plain_path(path: Column) -> Column:
    """Without query, fragment and trailing slashes, and with a star for each parameter."""
    bare = F.split(path, "[?#]")[0]
    trimmed = F.when(F.length(bare) > 1, F.regexp_replace(bare, "/+$", "")).otherwise(bare)
    return F.array_join(F.transform(F.split(trimmed, "/"), lambda s: F.when(s.rlike(PARAMETER), "*").otherwise(s)), "/")


def link_client_calls(calls: DataFrame, graph: Graph) -> DataFrame:
    """Calls (repo_id, caller_id, method, url) of local paths, linked to the routes they meet: distinct (repo_id, caller_id, route_id).

    A null method meets any, and so does a route for ALL.
    """
    wanted = calls.where(F.col("url").startswith("/")).select("repo_id", "caller_id", F.upper("method").alias("wanted"), plain_path(F.col("url")).alias("path"))
    parts = F.split("name", " ", 2)
    routes = graph.of_kind("Route").where(F.col("name").contains(" ")).select("repo_id", F.col("id").alias("route_id"), F.upper(parts[0]).alias("method"), plain_path(parts[1]).alias("path"))
    met = wanted.join(routes, ["repo_id", "path"]).where("wanted is null or method = 'ALL' or method = wanted")
    return met.select("repo_id", "caller_id", "route_id").distinct()


def merged_routes(seen: DataFrame) -> DataFrame:
    """Registrations (repo_id, method, path, file_id, line, confidence) merged by route: a file only if there is just one."""
    rid = route_id(F.col("method"), F.col("path"))
    return (
        seen.withColumn("id", rid)
        .where("id is not null")
        .groupBy("repo_id", "id")
        .agg(
            F.element_at(F.array(*[F.lit(c) for c in CONFIDENCES]), F.min(confidence_rank(F.col("confidence"))) + 1).alias("confidence"),
            F.count(F.lit(1)).alias("registrations"),
            F.when(F.countDistinct("file_id") == 1, F.min("file_id")).alias("file_id"),
            F.array_sort(F.collect_set("line")).alias("lines"),
        )
    )


# --- validation ---
def violations(graph: Graph) -> DataFrame:
    """Breaches of the graph's rules: (repo_id, rule, id), one row each.

    Unique ids of nodes and edges, files that exist, ends that exist, and ends of the kinds each relationship allows.
    """
    nodes, edges = graph.nodes, graph.edges
    kinds = nodes.select("repo_id", "id", "kind")
    files = nodes.where("kind = 'File'").select("repo_id", F.col("id").alias("file_id"))
    rules = nodes.sparkSession.createDataFrame(
        [(t, s, e) for t, (ss, es) in ENDPOINTS.items() for s in ss for e in es], "type string, source_kind string, target_kind string"
    )  # a fixed table of a few hundred rows
    ends = edges.select("repo_id", "id", "type", "source_id", "target_id")
    typed = (
        ends.join(kinds.select("repo_id", F.col("id").alias("source_id"), F.col("kind").alias("source_kind")), ["repo_id", "source_id"])
        .join(kinds.select("repo_id", F.col("id").alias("target_id"), F.col("kind").alias("target_kind")), ["repo_id", "target_id"])
    )
    parts = [
        ("node-id-twice", nodes.groupBy("repo_id", "id").count().where("count > 1")),
        ("edge-id-twice", edges.groupBy("repo_id", "id").count().where("count > 1")),
        ("file-missing", nodes.where("file_id is not null").join(files, ["repo_id", "file_id"], "left_anti")),
        ("provenance-file-missing", edges.where("provenance_file is not null").withColumn("file_id", F.col("provenance_file")).join(files, ["repo_id", "file_id"], "left_anti")),
        ("source-missing", ends.join(kinds.select("repo_id", F.col("id").alias("source_id")), ["repo_id", "source_id"], "left_anti")),
        ("target-missing", ends.join(kinds.select("repo_id", F.col("id").alias("target_id")), ["repo_id", "target_id"], "left_anti")),
        ("ends-not-allowed", typed.join(F.broadcast(rules), ["type", "source_kind", "target_kind"], "left_anti")),
    ]
    return reduce(DataFrame.unionByName, [df.select("repo_id", F.lit(rule).alias("rule"), "id") for rule, df in parts])


class InvalidGraph(ValueError):
    pass


def validate(graph: Graph) -> None:
    """Raise ``InvalidGraph`` with the first violation, if there is one."""
    first = violations(graph).orderBy("rule", "repo_id", "id").first()
    if first is not None:
        raise InvalidGraph(f"{first['rule']}: {first['id']} in repository {first['repo_id']}")
