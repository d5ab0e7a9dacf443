"""How well references were resolved, and how two graphs or a graph and the truth compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.values import round_half_up
from lodestone.functions.vocabulary import CONFIDENCES, ECOSYSTEMS
from lodestone.plans.graph import Graph


def rate(a, b):
    """a / (a + b), null where both are 0."""
    return F.when(a + b > 0, a.cast("double") / F.when(a + b > 0, a + b))


def confidences(graph: Graph) -> DataFrame:
    """Edges of each relationship there is, by confidence, zero-filled."""
    return graph.edges.groupBy("repo_id", "type").agg(*[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in CONFIDENCES])


def bind_rates(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(repo_id, type, resolved, unresolved, rate); types on either side."""
    a = edges.groupBy("repo_id", "type").agg(F.count(F.lit(1)).alias("resolved"))
    b = unresolved.groupBy("repo_id", "type").agg(F.count(F.lit(1)).alias("unresolved"))
    both = a.join(b, ["repo_id", "type"], "full_outer").fillna(0, ["resolved", "unresolved"])
    return both.withColumn("rate", rate(F.col("resolved"), F.col("unresolved")))


def unresolved_reasons(unresolved: DataFrame) -> DataFrame:
    return unresolved.groupBy("repo_id", "type", "reason").agg(F.count(F.lit(1)).alias("n"))


def target_reach(graph: Graph) -> DataFrame:
    """Calls that end inside, at a named external, or at an opaque one (an external without a name or outside the analysis)."""
    target = F.col("target_id")
    opaque = target.rlike("^ext:[^:]+$") | target.startswith("ext:outside-analysis")
    kind = F.when(~target.startswith("ext:"), "internal").when(opaque, "opaque").otherwise("named")
    return graph.of_type("CALLS").groupBy("repo_id").agg(*[F.count_if(kind == k).alias(k) for k in ("internal", "named", "opaque")])


def internal_bind_rate(graph: Graph, unbound: DataFrame) -> DataFrame:
    """Internal calls by internal and unbound ones; a null rate where there are neither."""
    inside = graph.of_type("CALLS").where("target_id not like 'ext:%'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("internal"))
    lost = unbound.where("type = 'CALLS'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("unbound"))
    both = inside.join(lost, "repo_id", "full_outer").fillna(0, ["internal", "unbound"])
    return both.withColumn("rate", rate(F.col("internal"), F.col("unbound")))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two measurements (repo_id, type, rate) side by side, the difference in percentage points."""
    a, b = before.withColumnRenamed("rate", "before"), after.withColumnRenamed("rate", "after")
    return a.join(b, ["repo_id", "type"], "full_outer").withColumn("points", round_half_up((F.col("after") - F.col("before")) * 100, 4))


def precision_recall(expected: DataFrame, produced: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Set comparison by group: expected, produced and matched, precision and recall (null where undefined).

    Groups that aren't expected are not measured.
    """
    e = expected.select(*group, *key).distinct().withColumn("e", F.lit(1))
    p = produced.join(expected.select(*group).distinct(), group, "left_semi").select(*group, *key).distinct().withColumn("p", F.lit(1))
    counted = e.join(p, [*group, *key], "full_outer").groupBy(*group).agg(
        F.count("e").alias("expected"), F.count("p").alias("produced"), F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("matched")
    )
    part = lambda b: F.when(F.col(b) > 0, F.col("matched").cast("double") / F.when(F.col(b) > 0, F.col(b)))
    return counted.withColumn("precision", part("produced")).withColumn("recall", part("expected"))


def packages_used(graph: Graph) -> DataFrame:
    return graph.of_kind("External").where(F.col("external_kind").isin(*ECOSYSTEMS)).select("repo_id", "id")
