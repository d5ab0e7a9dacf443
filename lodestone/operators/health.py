"""Health of repository graphs: coupling, counts, distributions, routing, environment, findings.

Every function takes a Graph of many repositories and keeps ``repo_id`` first. Counts over a vocabulary are zero-filled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.values import round_half_up
from lodestone.functions.vocabulary import CONFIDENCES, COUPLING, ECOSYSTEMS, FINDINGS, KINDS, RELATIONSHIPS
from lodestone.operators.traversal import components, cycles, reach
from lodestone.plans.graph import Graph, confidence_rank, is_declaration

#: Most entries of a list of the most connected nodes, and of a sample (fixed values).
MOST_CONNECTED, SAMPLE = 20, 50


def ratio(a: Column, b: Column) -> Column:
    """a / b, rounded to four places; 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(round_half_up(a.cast("double") / F.when(b != 0, b), 4))


def node_metrics(graph: Graph) -> DataFrame:
    """Distinct neighbours and edge counts of every node, over the coupling relationships."""
    pairs, edges = graph.coupling, graph.of_type(*COUPLING)
    fan_in = pairs.groupBy("repo_id", F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    fan_out = pairs.groupBy("repo_id", F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    incoming = edges.groupBy("repo_id", F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("incoming_edges"))
    outgoing = edges.groupBy("repo_id", F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("outgoing_edges"))
    out = graph.nodes.select("repo_id", "id", "kind")
    for part in (fan_in, fan_out, incoming, outgoing):
        out = out.join(part, ["repo_id", "id"], "left")
    return out.fillna(0, ["fan_in", "fan_out", "incoming_edges", "outgoing_edges"])


def _fill(repos: DataFrame, words: list[str], name: str) -> DataFrame:
    """Every repository with every word of a vocabulary."""
    return repos.select("repo_id").distinct().select("repo_id", F.explode(F.array(*[F.lit(w) for w in words])).alias(name))


def kind_counts(graph: Graph) -> DataFrame:
    counted = graph.nodes.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("nodes"))
    return _fill(graph.nodes, KINDS, "kind").join(counted, ["repo_id", "kind"], "left").fillna(0, ["nodes"])


def relationship_counts(graph: Graph) -> DataFrame:
    """Edges of every relationship and the weakest confidence among them (CERTAIN where there are none)."""
    counted = graph.edges.groupBy("repo_id", "type").agg(F.count(F.lit(1)).alias("edges"), F.max(confidence_rank(F.col("confidence"))).alias("rank"))
    words = F.array(*[F.lit(c) for c in CONFIDENCES])
    return (
        _fill(graph.nodes, RELATIONSHIPS, "type")
        .join(counted, ["repo_id", "type"], "left")
        .select("repo_id", "type", F.coalesce("edges", F.lit(0)).alias("edges"), F.element_at(words, F.coalesce("rank", F.lit(0)) + 1).alias("weakest"))
    )


def external_counts(graph: Graph) -> DataFrame:
    """Externals by kind, and whether the kind is an ecosystem's, so that they are packages."""
    return (
        graph.of_kind("External")
        .groupBy("repo_id", "external_kind")
        .agg(F.count(F.lit(1)).alias("externals"))
        .withColumn("package", F.coalesce(F.col("external_kind").isin(*ECOSYSTEMS), F.lit(False)))
    )


def graph_ends(graph: Graph) -> DataFrame:
    """Nodes and edges of the dependency graph (IMPORTS and EXPORTS) and of the call graph."""
    parts = []
    for name, types in (("dependency", ["IMPORTS", "EXPORTS"]), ("call", ["CALLS"])):
        edges = graph.of_type(*types)
        ends = edges.select("repo_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        size = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"))
        parts.append(ends.groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes")).join(size, "repo_id").withColumn("graph", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).select("repo_id", "graph", "nodes", "edges")


def most_connected(graph: Graph, most: int = MOST_CONNECTED) -> DataFrame:
    """The lists of most connected nodes: declarations by fan-in and by fan-out, files by their sum; ties by id."""
    metrics = node_metrics(graph)
    decl, files = metrics.where(is_declaration()), metrics.where("kind = 'File'")
    lists = [("fan-in", decl, F.col("fan_in")), ("fan-out", decl, F.col("fan_out")), ("files", files, F.col("fan_in") + F.col("fan_out"))]
    union = reduce(DataFrame.unionByName, [df.select("repo_id", "id", F.lit(n).alias("list"), v.alias("value")) for n, df, v in lists]).where("value > 0")
    order = Window.partitionBy("repo_id", "list").orderBy(F.col("value").desc(), "id")
    return union.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def unconnected(graph: Graph) -> DataFrame:
    """Declarations that nothing refers to, that refer to nothing, and that do neither: totals."""
    m = node_metrics(graph).where(is_declaration())
    return m.groupBy("repo_id").agg(
        F.count_if(F.expr("fan_in = 0")).alias("without_incoming"),
        F.count_if(F.expr("fan_out = 0")).alias("without_outgoing"),
        F.count_if(F.expr("fan_in = 0 and fan_out = 0")).alias("isolated"),
        F.count(F.lit(1)).alias("declarations"),
    )


def distributions(graph: Graph) -> DataFrame:
    """Least, greatest, mean, median and ninetieth percentile (nearest rank) of fan-in, fan-out and declarations of a file."""
    metrics = node_metrics(graph).where(is_declaration())
    per_file = declarations_per_file(graph).select("repo_id", F.col("declarations").alias("value"), F.lit("declarations-per-file").alias("measure"))
    values = per_file.unionByName(metrics.select("repo_id", F.col("fan_in").alias("value"), F.lit("fan-in").alias("measure"))).unionByName(
        metrics.select("repo_id", F.col("fan_out").alias("value"), F.lit("fan-out").alias("measure"))
    )
    # counted by value first, so that no task holds all values of a repository
    counted = values.groupBy("repo_id", "measure", "value").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("repo_id", "measure").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy("repo_id", "measure")))

    def at(p: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("total")), F.col("value")))

    return ranked.groupBy("repo_id", "measure").agg(
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        round_half_up(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 4).alias("mean"),
        at(0.5).alias("median"),
        at(0.9).alias("p90"),
        F.sum("n").alias("count"),
    )


def declarations_per_file(graph: Graph) -> DataFrame:
    counted = graph.nodes.where(is_declaration()).groupBy("repo_id", F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("declarations"))
    return graph.of_kind("File").select("repo_id", "id").join(counted, ["repo_id", "id"], "left").fillna(0, ["declarations"])


def external_usage(graph: Graph) -> DataFrame:
    """Importing nodes and import edges of every external, also of those that nothing imports."""
    used = graph.of_type("IMPORTS").groupBy("repo_id", F.col("target_id").alias("id")).agg(
        F.countDistinct("source_id").alias("importers"), F.count(F.lit(1)).alias("imports")
    )
    return graph.of_kind("External").select("repo_id", "id", "external_kind").join(used, ["repo_id", "id"], "left").fillna(0, ["importers", "imports"])


def call_edges(graph: Graph) -> DataFrame:
    """Distinct calls between declarations or files."""
    inner = graph.nodes.where(is_declaration() | (F.col("kind") == "File")).select("repo_id", "id")
    calls = graph.of_type("CALLS").select("repo_id", "source_id", "target_id").distinct()
    for end in ("source_id", "target_id"):
        calls = calls.join(inner.withColumnRenamed("id", end), ["repo_id", end], "left_semi")
    return calls.select("repo_id", "source_id", "target_id")


def recursive_declarations(graph: Graph) -> DataFrame:
    return graph.of_type("CALLS").where("source_id = target_id").select("repo_id", F.col("source_id").alias("id")).distinct()


def call_clusters(graph: Graph) -> DataFrame:
    """Weak components of the call graph: number, greatest size, and those of one node."""
    sized = components(call_edges(graph)).groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return sized.groupBy("repo_id").agg(F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest"), F.count_if(F.expr("size = 1")).alias("singletons"))


def call_depth(graph: Graph) -> DataFrame:
    """Entry points (callers that nothing calls) and the greatest distance from the nearest of them."""
    calls = call_edges(graph)
    called = calls.select("repo_id", F.col("target_id").alias("id")).distinct()
    roots = calls.select("repo_id", F.col("source_id").alias("id")).distinct().join(called, ["repo_id", "id"], "left_anti")
    return reach(calls, roots).groupBy("repo_id").agg(F.count_if(F.expr("depth = 0")).alias("entry_points"), F.max("depth").alias("depth"))


def call_cycles(graph: Graph) -> DataFrame:
    return cycles(call_edges(graph))


def import_cycles(graph: Graph) -> DataFrame:
    return cycles(graph.module_edges())


def routing(graph: Graph) -> DataFrame:
    """Routes by method, and how many have no handler."""
    handled = graph.of_type("HANDLED_BY").select("repo_id", F.col("source_id").alias("id")).distinct().withColumn("handled", F.lit(True))
    routes = graph.of_kind("Route").select("repo_id", "id", F.regexp_extract("id", "^route:([^:]+):(.+)$", 1).alias("method"))
    return (
        routes.join(handled, ["repo_id", "id"], "left")
        .groupBy("repo_id", "method")
        .agg(F.count(F.lit(1)).alias("routes"), F.count_if(F.col("handled").isNull()).alias("orphans"))
    )


def repeated_handlers(graph: Graph) -> DataFrame:
    """Places in a route's chain with more than one handler edge, and handlers of more than one route."""
    edges = graph.of_type("HANDLED_BY")
    places = edges.groupBy("repo_id", F.col("source_id").alias("id"), F.coalesce("ordinal", F.lit(0)).alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = edges.groupBy("repo_id", F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("n")).where("n > 1")
    return places.select("repo_id", F.lit("place").alias("what"), "id", "place", "n").unionByName(
        shared.select("repo_id", F.lit("handler").alias("what"), "id", F.lit(0).alias("place"), "n")
    )


def environment(graph: Graph) -> DataFrame:
    """Reads and distinct readers of every environment variable; never read, or read more than once."""
    reads = graph.of_type("READS").groupBy("repo_id", F.col("target_id").alias("id")).agg(
        F.count(F.lit(1)).alias("reads"), F.countDistinct("source_id").alias("readers")
    )
    out = graph.of_kind("EnvironmentVariable").select("repo_id", "id").join(reads, ["repo_id", "id"], "left").fillna(0, ["reads", "readers"])
    return out.withColumn("never_read", F.col("reads") == 0).withColumn("repeated", F.col("reads") > 1)


def repository_metrics(graph: Graph) -> DataFrame:
    """Averages, density and coverage of each repository."""
    nodes = graph.nodes.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(is_declaration()).alias("declarations"), F.count_if(F.expr("kind = 'File'")).alias("files")
    )
    edges = graph.edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("type").isin(*COUPLING)).alias("references"))
    referenced = graph.coupling.select("repo_id", F.col("target_id").alias("id")).distinct()
    hit = graph.nodes.where(is_declaration()).join(referenced, ["repo_id", "id"], "left_semi").groupBy("repo_id").agg(F.count(F.lit(1)).alias("hit"))
    all_ = nodes.join(edges, "repo_id", "left").join(hit, "repo_id", "left").fillna(0)
    return all_.select(
        "repo_id",
        ratio(F.col("declarations"), F.col("files")).alias("declarations_per_file"),
        ratio(F.col("references"), F.col("declarations")).alias("references_per_declaration"),
        ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"),
        ratio(F.col("hit"), F.col("declarations")).alias("reference_coverage"),
    )


def findings(graph: Graph) -> DataFrame:
    """Findings of the relational kind with their true counts: (repo_id, code, nodes, truncated), in vocabulary order by ``place``.

    A file's fan is high when it is strictly above the ninetieth percentile of the repository's files. ``truncated``
    tells that a report that lists ``SAMPLE`` nodes would not list all.
    """
    metrics = node_metrics(graph)
    decl = metrics.where(is_declaration())
    imported = graph.of_type("IMPORTS").select("repo_id", F.col("target_id").alias("id")).distinct()
    exported = graph.nodes.where(is_declaration() & (F.col("is_exported") | F.coalesce("is_exported_from_module", F.lit(False)))).select("repo_id", "id")
    parts = [
        ("declaration-never-referenced", decl.where("fan_in = 0")),
        ("exported-declaration-never-imported", exported.join(imported, ["repo_id", "id"], "left_anti")),
        ("declaration-isolated", decl.where("fan_in = 0 and fan_out = 0")),
        ("environment-variable-never-read", environment(graph).where("never_read")),
        ("route-without-handler", graph.of_kind("Route").join(graph.of_type("HANDLED_BY").select("repo_id", F.col("source_id").alias("id")).distinct(), ["repo_id", "id"], "left_anti")),
        ("route-registered-twice", repeated_handlers(graph).where("what = 'place'")),
    ]
    files = metrics.where("kind = 'File'")
    for code, c in (("file-high-fan-in", "fan_in"), ("file-high-fan-out", "fan_out")):
        limit = files.groupBy("repo_id").agg(F.expr(f"percentile_disc(0.9) within group (order by {c})").alias("p90"))
        parts.append((code, files.join(limit, "repo_id").where(F.col(c) > F.col("p90"))))
    union = reduce(DataFrame.unionByName, [df.select("repo_id", F.lit(code).alias("code")) for code, df in parts])
    places = F.create_map(*[F.lit(x) for i, c in enumerate(FINDINGS) for x in (c, i)])
    return (
        union.groupBy("repo_id", "code")
        .agg(F.count(F.lit(1)).alias("nodes"))
        .withColumn("truncated", F.col("nodes") > SAMPLE)
        .withColumn("place", places[F.col("code")])
    )
