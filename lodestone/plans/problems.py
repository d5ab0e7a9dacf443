"""The general problems of TESTDATA.md: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.values import bare, instant_us
from lodestone.operators.hotkeys import heavy_keys, key_profile
from lodestone.operators.snapshots import snapshot_changes
from lodestone.plans.staging import join_small
from lodestone.plans.standing import standing
from lodestone.sources.tables import table

#: Share of all edges from which a target counts as hot.
HOT_SHARE = 0.01


def node_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = table(spark, sf_dir, "revisions").select(
        "repo_id", F.col("id").alias("revision_id"), instant_us(F.col("created_at")).alias("instant")
    )
    return snapshot_changes(
        table(spark, sf_dir, "nodes"),
        revisions,
        series=["repo_id"],
        snapshot="revision_id",
        key=["id"],
        version="loaded_at",
        instant="instant",
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_changes(spark, sf_dir).select("repo_id", "revision_id", "id", "change")


def p1_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field changed, for each repository and later revision."""
    return (
        node_changes(spark, sf_dir)
        .select("repo_id", "revision_id", F.explode("changed_fields").alias("field"))
        .groupBy("repo_id", "revision_id", "field")
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def edge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (repo_id, id) of edges once: target id and the line it is used in.

    The copies of an edge meet under 128 bits of hash of its id and 8 of its target: the id names source, target and
    place, so copies agree in both columns.
    """
    edges = table(spark, sf_dir, "edges")
    return (
        edges.select(
            "repo_id",
            F.xxhash64("id").alias("h1"),
            F.xxhash64(F.lit(1), F.col("id")).alias("h2"),
            bare(F.col("target_id")).alias("id"),
            F.col("location.start_line").alias("line"),
        )
        .groupBy("repo_id", "h1", "h2", "id")
        .agg(F.min("line").alias("line"))
        .select("id", "line")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a target holds at least 1 % of all edges, so there are at most 100: a proven bound for the broadcast
    hot = heavy_keys(edge_targets(spark, sf_dir), ["id"], HOT_SHARE).select("id")
    nodes = table(spark, sf_dir, "nodes").select("repo_id", "revision_id", "id", "kind", "loaded_at").join(F.broadcast(hot), "id")
    of = table(spark, sf_dir, "edges").select("repo_id", "revision_id").distinct()
    latest = join_small(nodes, of, ["repo_id", "revision_id"], "left_semi", salt=["id"])
    return (
        standing(latest, ["repo_id", "revision_id", "id"], "loaded_at", [F.col("kind").desc_nulls_last()]).select("id", "kind").distinct()
    )


def p3_target_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every target and the quartiles of the lines they stand in."""
    return key_profile(edge_targets(spark, sf_dir), ["id"], "line", (0.25, 0.5, 0.75)).select(
        "id", F.col("n").alias("edges"), F.col("q0").alias("line_p25"), F.col("q1").alias("line_p50"), F.col("q2").alias("line_p75")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_changed_fields, p3_found, p3_target_profile)}

_FIELDS = (
    "kind name file_id container_chain visibility is_exported is_static is_abstract is_readonly is_optional is_async "
    "is_declaration_file has_symbol is_exported_from_module external_kind external_name language file_role category "
    "artifact_kind confidence provenance locations"
).split()

_STEPS = """
WITH rev AS (
  SELECT repo_id, id AS revision_id,
         max(CAST(CASE WHEN regexp_matches(created_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN created_at ELSE created_at || 'Z' END AS TIMESTAMPTZ)) AS instant
  FROM revisions GROUP BY 1, 2),
standing AS (
  SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY repo_id, revision_id, id ORDER BY loaded_at DESC) = 1),
steps AS (
  SELECT repo_id, revision_id, lag(revision_id) OVER (PARTITION BY repo_id ORDER BY instant, revision_id) AS before
  FROM (SELECT DISTINCT repo_id, revision_id FROM nodes) JOIN rev USING (repo_id, revision_id)),
later AS (SELECT s.before, n.* FROM standing n JOIN steps s USING (repo_id, revision_id) WHERE s.before IS NOT NULL),
earlier AS (
  SELECT s.revision_id AS later, n.* FROM standing n JOIN steps s ON n.repo_id = s.repo_id AND n.revision_id = s.before),
pairs AS (
  SELECT coalesce(l.repo_id, e.repo_id) AS repo_id, coalesce(l.revision_id, e.later) AS revision_id, coalesce(l.id, e.id) AS id,
         l.id IS NULL AS gone, e.id IS NULL AS fresh, {same}
  FROM later l FULL JOIN earlier e ON l.repo_id = e.repo_id AND l.revision_id = e.later AND l.id = e.id)
"""

SQL = {
    "p1_found": _STEPS.format(same="(" + " OR ".join(f"l.{f} IS DISTINCT FROM e.{f}" for f in _FIELDS) + ") AS differs")
    + """SELECT repo_id, revision_id, id, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change
FROM pairs WHERE fresh OR gone OR differs""",
    "p1_changed_fields": _STEPS.format(same=", ".join(f"l.{f} IS DISTINCT FROM e.{f} AS d_{f}" for f in _FIELDS))
    + "SELECT repo_id, revision_id, field, count(*) AS nodes FROM ("
    + " UNION ALL ".join(f"SELECT repo_id, revision_id, '{f}' AS field FROM pairs WHERE NOT gone AND NOT fresh AND d_{f}" for f in _FIELDS)
    + ") GROUP BY 1, 2, 3",
}

_TARGETS = """
WITH e AS (
  SELECT repo_id, id AS edge_id, regexp_replace(target_id, '^\\s+|\\s+$', '', 'g') AS id, min(location.start_line) AS line, any_value(revision_id) AS revision_id
  FROM edges GROUP BY repo_id, edge_id, regexp_replace(target_id, '^\\s+|\\s+$', '', 'g'))
"""
SQL |= {
    "p3_found": _TARGETS
    + """, hot AS (SELECT id FROM e GROUP BY id HAVING count(*) >= 0.01 * (SELECT count(*) FROM e)),
n AS (
  SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY repo_id, revision_id, id ORDER BY loaded_at DESC) = 1)
SELECT DISTINCT n.id, n.kind FROM n JOIN hot USING (id) WHERE (n.repo_id, n.revision_id) IN (SELECT (repo_id, revision_id) FROM edges)""",
    "p3_target_profile": _TARGETS
    + """SELECT id, count(*) AS edges, CAST(quantile_disc(line, 0.25) AS DOUBLE) AS line_p25,
  CAST(quantile_disc(line, 0.5) AS DOUBLE) AS line_p50, CAST(quantile_disc(line, 0.75) AS DOUBLE) AS line_p75
FROM e GROUP BY id""",
}
