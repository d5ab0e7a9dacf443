"""Queries on the health of repository graphs and their SQL."""

from __future__ import annotations

from lodestone.functions.vocabulary import COUPLING, DECLARATIONS, ECOSYSTEMS, FINDINGS, KINDS, RELATIONSHIPS
from lodestone.operators import health
from lodestone.plans.graph import COUPLING_SQL, GRAPH_SQL, MODULE_SQL, in_list, load_graph

DECL = in_list(DECLARATIONS)
COUP = in_list(COUPLING)


def on_graph(operator):
    return lambda spark, sf_dir: operator(load_graph(spark, sf_dir))


METRICS_SQL = f"""{COUPLING_SQL},
metrics AS (
  SELECT n.repo_id, n.id, n.kind, coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out, coalesce(ei.n, 0) AS incoming_edges, coalesce(eo.n, 0) AS outgoing_edges
  FROM g_nodes n
  LEFT JOIN (SELECT repo_id, target_id AS id, count(*) n FROM coupling GROUP BY 1, 2) fi USING (repo_id, id)
  LEFT JOIN (SELECT repo_id, source_id AS id, count(*) n FROM coupling GROUP BY 1, 2) fo USING (repo_id, id)
  LEFT JOIN (SELECT repo_id, target_id AS id, count(*) n FROM g_edges WHERE type IN {COUP} GROUP BY 1, 2) ei USING (repo_id, id)
  LEFT JOIN (SELECT repo_id, source_id AS id, count(*) n FROM g_edges WHERE type IN {COUP} GROUP BY 1, 2) eo USING (repo_id, id))"""
CALLS_SQL = f"""inner_nodes AS (SELECT repo_id, id FROM g_nodes WHERE kind IN {DECL} OR kind = 'File'),
calls AS (
  SELECT DISTINCT e.repo_id, e.source_id, e.target_id FROM g_edges e JOIN inner_nodes s ON s.repo_id = e.repo_id AND s.id = e.source_id
  JOIN inner_nodes t ON t.repo_id = e.repo_id AND t.id = e.target_id WHERE e.type = 'CALLS')"""
RECURSIVE = "WITH RECURSIVE" + GRAPH_SQL.strip()[4:]


def cycle_sql(edges: str) -> str:
    """Nodes that reach themselves, with the least id of their cycle; ``edges`` is a relation of the common table expressions."""
    return f"""closure AS (
  SELECT repo_id, source_id AS a, target_id AS b FROM {edges}
  UNION SELECT c.repo_id, c.a, e.target_id FROM closure c JOIN {edges} e ON e.repo_id = c.repo_id AND e.source_id = c.b),
both_ways AS (SELECT x.repo_id, x.a, x.b FROM closure x JOIN closure y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a)
SELECT repo_id, a AS id, least(a, min(b)) AS cycle FROM both_ways GROUP BY repo_id, a"""


def values(words: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{w}')" for w in words) + ")"


def listed(name: str, where: str, value: str) -> str:
    return f"SELECT repo_id, id, '{name}' AS list, {value} AS value FROM metrics WHERE {where} AND {value} > 0"


_H = {
    "h_node_metrics": (health.node_metrics, f"{GRAPH_SQL}, {METRICS_SQL} SELECT * FROM metrics"),
    "h_kind_counts": (
        health.kind_counts,
        f"{GRAPH_SQL} SELECT r.repo_id, k.kind, (SELECT count(*) FROM g_nodes n WHERE n.repo_id = r.repo_id AND n.kind = k.kind) AS nodes "
        f"FROM (SELECT DISTINCT repo_id FROM g_nodes) r CROSS JOIN {values(KINDS)} k(kind)",
    ),
    "h_relationship_counts": (
        health.relationship_counts,
        f"""{GRAPH_SQL}, counted AS (
  SELECT repo_id, type, count(*) AS edges, max(CASE confidence WHEN 'CERTAIN' THEN 0 WHEN 'RESOLVED' THEN 1 WHEN 'INFERRED' THEN 2 ELSE 3 END) AS r
  FROM g_edges GROUP BY 1, 2)
SELECT r.repo_id, k.type, coalesce(c.edges, 0) AS edges, ['CERTAIN', 'RESOLVED', 'INFERRED', 'AMBIGUOUS'][coalesce(c.r, 0) + 1] AS weakest
FROM (SELECT DISTINCT repo_id FROM g_nodes) r CROSS JOIN {values(RELATIONSHIPS)} k(type) LEFT JOIN counted c ON c.repo_id = r.repo_id AND c.type = k.type""",
    ),
    "h_external_counts": (
        health.external_counts,
        f"{GRAPH_SQL} SELECT repo_id, external_kind, count(*) AS externals, coalesce(external_kind IN {in_list(ECOSYSTEMS)}, false) AS package FROM g_nodes WHERE kind = 'External' GROUP BY 1, 2",
    ),
    "h_graph_ends": (
        health.graph_ends,
        f"""{GRAPH_SQL}, g AS (SELECT *, CASE WHEN type = 'CALLS' THEN 'call' ELSE 'dependency' END AS graph FROM g_edges WHERE type IN ('IMPORTS', 'EXPORTS', 'CALLS'))
SELECT repo_id, graph, count(DISTINCT id) AS nodes, max(edges) AS edges FROM (
  SELECT repo_id, graph, unnest([source_id, target_id]) AS id, count(*) OVER (PARTITION BY repo_id, graph) AS edges FROM g) GROUP BY 1, 2""",
    ),
    "h_most_connected": (
        health.most_connected,
        f"""{GRAPH_SQL}, {METRICS_SQL}, u AS ({listed('fan-in', f'kind IN {DECL}', 'fan_in')} UNION ALL {listed('fan-out', f'kind IN {DECL}', 'fan_out')}
UNION ALL {listed('files', "kind = 'File'", '(fan_in + fan_out)')})
SELECT *, row_number() OVER (PARTITION BY repo_id, list ORDER BY value DESC, id) AS position FROM u QUALIFY position <= 20""",
    ),
    "h_unconnected": (
        health.unconnected,
        f"""{GRAPH_SQL}, {METRICS_SQL} SELECT repo_id, count(*) FILTER (fan_in = 0) AS without_incoming, count(*) FILTER (fan_out = 0) AS without_outgoing,
count(*) FILTER (fan_in = 0 AND fan_out = 0) AS isolated, count(*) AS declarations FROM metrics WHERE kind IN {DECL} GROUP BY 1""",
    ),
    "h_distributions": (
        health.distributions,
        f"""{GRAPH_SQL}, {METRICS_SQL}, v AS (
  SELECT repo_id, 'fan-in' AS measure, fan_in AS value FROM metrics WHERE kind IN {DECL} UNION ALL
  SELECT repo_id, 'fan-out', fan_out FROM metrics WHERE kind IN {DECL} UNION ALL
  SELECT f.repo_id, 'declarations-per-file', count(d.id) FROM g_nodes f LEFT JOIN g_nodes d ON d.repo_id = f.repo_id AND d.file_id = f.id AND d.kind IN {DECL}
  WHERE f.kind = 'File' GROUP BY f.repo_id, f.id)
SELECT repo_id, measure, min(value) AS least, max(value) AS greatest, floor(CAST(sum(value) AS DOUBLE) / count(*) * 10000 + 0.5) / 10000 AS mean,
  quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90, count(*) AS count FROM v GROUP BY 1, 2""",
    ),
    "h_declarations_per_file": (
        health.declarations_per_file,
        f"""{GRAPH_SQL} SELECT f.repo_id, f.id, count(d.id) AS declarations FROM g_nodes f
LEFT JOIN g_nodes d ON d.repo_id = f.repo_id AND d.file_id = f.id AND d.kind IN {DECL} WHERE f.kind = 'File' GROUP BY 1, 2""",
    ),
    "h_external_usage": (
        health.external_usage,
        f"""{GRAPH_SQL} SELECT n.repo_id, n.id, n.external_kind, count(DISTINCT e.source_id) AS importers, count(e.id) AS imports FROM g_nodes n
LEFT JOIN g_edges e ON e.repo_id = n.repo_id AND e.target_id = n.id AND e.type = 'IMPORTS' WHERE n.kind = 'External' GROUP BY 1, 2, 3""",
    ),
    "h_recursive": (health.recursive_declarations, f"{GRAPH_SQL} SELECT DISTINCT repo_id, source_id AS id FROM g_edges WHERE type = 'CALLS' AND source_id = target_id"),
    "h_call_clusters": (
        health.call_clusters,
        f"""{RECURSIVE}, {CALLS_SQL}, both_ends AS (SELECT repo_id, source_id AS a, target_id AS b FROM calls UNION SELECT repo_id, target_id, source_id FROM calls),
walk AS (SELECT repo_id, a, a AS b FROM both_ends UNION SELECT w.repo_id, w.a, e.b FROM walk w JOIN both_ends e ON e.repo_id = w.repo_id AND e.a = w.b),
named AS (SELECT repo_id, a, min(b) AS component FROM walk GROUP BY 1, 2), sized AS (SELECT repo_id, component, count(*) AS size FROM named GROUP BY 1, 2)
SELECT repo_id, count(*) AS clusters, max(size) AS largest, count(*) FILTER (size = 1) AS singletons FROM sized GROUP BY 1""",
    ),
    "h_call_depth": (
        health.call_depth,
        f"""{RECURSIVE}, {CALLS_SQL}, roots AS (SELECT DISTINCT repo_id, source_id AS id FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls d WHERE d.repo_id = c.repo_id AND d.target_id = c.source_id)),
walk(repo_id, id, depth) USING KEY (repo_id, id) AS (
  SELECT repo_id, id, 0 FROM roots
  UNION SELECT DISTINCT w.repo_id, c.target_id, w.depth + 1 FROM walk w JOIN calls c ON c.repo_id = w.repo_id AND c.source_id = w.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.repo_id = w.repo_id AND r.id = c.target_id))
SELECT repo_id, count(*) FILTER (depth = 0) AS entry_points, max(depth) AS depth FROM walk GROUP BY 1""",
    ),
    "h_call_cycles": (health.call_cycles, f"{RECURSIVE}, {CALLS_SQL}, {cycle_sql('calls')}"),
    "h_import_cycles": (health.import_cycles, f"{RECURSIVE}, {MODULE_SQL}, {cycle_sql('modules')}"),
    "h_routing": (
        health.routing,
        f"""{GRAPH_SQL} SELECT n.repo_id, regexp_extract(n.id, '^route:([^:]+):(.+)$', 1) AS method, count(*) AS routes,
count(*) FILTER (NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.repo_id = n.repo_id AND e.source_id = n.id AND e.type = 'HANDLED_BY')) AS orphans
FROM g_nodes n WHERE n.kind = 'Route' GROUP BY 1, 2""",
    ),
    "h_repeated_handlers": (
        health.repeated_handlers,
        f"""{GRAPH_SQL}, h AS (SELECT * FROM g_edges WHERE type = 'HANDLED_BY')
SELECT repo_id, 'place' AS what, source_id AS id, coalesce(ordinal, 0) AS place, count(*) AS n FROM h GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT repo_id, 'handler', target_id, 0, count(DISTINCT source_id) FROM h GROUP BY ALL HAVING count(DISTINCT source_id) > 1""",
    ),
    "h_environment": (
        health.environment,
        f"""{GRAPH_SQL} SELECT n.repo_id, n.id, count(e.id) AS reads, count(DISTINCT e.source_id) AS readers, count(e.id) = 0 AS never_read, count(e.id) > 1 AS repeated
FROM g_nodes n LEFT JOIN g_edges e ON e.repo_id = n.repo_id AND e.target_id = n.id AND e.type = 'READS' WHERE n.kind = 'EnvironmentVariable' GROUP BY 1, 2""",
    ),
    "h_repository_metrics": (
        health.repository_metrics,
        f"""{GRAPH_SQL}, {COUPLING_SQL}, n AS (SELECT repo_id, count(*) AS nodes, count(*) FILTER (kind IN {DECL}) AS d, count(*) FILTER (kind = 'File') AS f FROM g_nodes GROUP BY 1),
e AS (SELECT repo_id, count(*) AS edges, count(*) FILTER (type IN {COUP}) AS refs FROM g_edges GROUP BY 1),
h AS (SELECT g.repo_id, count(*) AS hit FROM g_nodes g WHERE g.kind IN {DECL} AND EXISTS (SELECT 1 FROM coupling c WHERE c.repo_id = g.repo_id AND c.target_id = g.id) GROUP BY 1),
j AS (SELECT n.*, coalesce(e.edges, 0) AS edges, coalesce(e.refs, 0) AS refs, coalesce(h.hit, 0) AS hit FROM n LEFT JOIN e USING (repo_id) LEFT JOIN h USING (repo_id))
SELECT repo_id, {', '.join(f"CASE WHEN {b} = 0 THEN 0.0 ELSE floor(CAST({a} AS DOUBLE) / {b} * 10000 + 0.5) / 10000 END AS {c}" for a, b, c in (('d', 'f', 'declarations_per_file'), ('refs', 'd', 'references_per_declaration'), ('edges', '(nodes * (nodes - 1))', 'density'), ('hit', 'd', 'reference_coverage')))} FROM j""",
    ),
    "h_findings": (
        health.findings,
        f"""{GRAPH_SQL}, {METRICS_SQL}, p AS (SELECT repo_id, quantile_disc(fan_in, 0.9) AS fi, quantile_disc(fan_out, 0.9) AS fo FROM metrics WHERE kind = 'File' GROUP BY 1),
f AS (
  SELECT repo_id, 'declaration-never-referenced' AS code FROM metrics WHERE kind IN {DECL} AND fan_in = 0
  UNION ALL SELECT n.repo_id, 'exported-declaration-never-imported' FROM g_nodes n WHERE n.kind IN {DECL} AND (n.is_exported OR coalesce(n.is_exported_from_module, false))
    AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.repo_id = n.repo_id AND e.target_id = n.id AND e.type = 'IMPORTS')
  UNION ALL SELECT repo_id, 'declaration-isolated' FROM metrics WHERE kind IN {DECL} AND fan_in = 0 AND fan_out = 0
  UNION ALL SELECT n.repo_id, 'environment-variable-never-read' FROM g_nodes n WHERE n.kind = 'EnvironmentVariable'
    AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.repo_id = n.repo_id AND e.target_id = n.id AND e.type = 'READS')
  UNION ALL SELECT n.repo_id, 'route-without-handler' FROM g_nodes n WHERE n.kind = 'Route'
    AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.repo_id = n.repo_id AND e.source_id = n.id AND e.type = 'HANDLED_BY')
  UNION ALL SELECT repo_id, 'route-registered-twice' FROM (SELECT repo_id, source_id, coalesce(ordinal, 0) FROM g_edges WHERE type = 'HANDLED_BY' GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT m.repo_id, 'file-high-fan-in' FROM metrics m JOIN p USING (repo_id) WHERE m.kind = 'File' AND m.fan_in > p.fi
  UNION ALL SELECT m.repo_id, 'file-high-fan-out' FROM metrics m JOIN p USING (repo_id) WHERE m.kind = 'File' AND m.fan_out > p.fo)
SELECT repo_id, code, count(*) AS nodes, count(*) > 50 AS truncated, list_position([{', '.join(f"'{c}'" for c in FINDINGS)}], code) - 1 AS place FROM f GROUP BY 1, 2""",
    ),
}
QUERIES = {k: on_graph(f) for k, (f, _) in _H.items()}
SQL = {k: q for k, (_, q) in _H.items()}
