"""Queries on lookups, impact and exploration of repository graphs and their SQL."""

from __future__ import annotations

from lodestone.operators import explorer, impact, lookup
from lodestone.plans.catalogue_health import DECL, METRICS_SQL, RECURSIVE, listed, on_graph
from lodestone.plans.graph import GRAPH_SQL, in_list, load_graph

_REF = "SELECT e.repo_id, e.target_id AS id, e.id AS edge_id, {cols}e.source_id, n.kind AS source_kind, n.name AS source_name FROM g_edges e LEFT JOIN g_nodes n ON n.repo_id = e.repo_id AND n.id = e.source_id WHERE {where}"


def _is(sign: str, kind: str) -> str:
    return f"e.type {sign} '{kind}'"


HUBS = f"""hubs AS (SELECT repo_id, id FROM metrics WHERE kind IN {DECL} QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, id) = 1)"""
PACKAGE = "array_to_string(list_slice(string_split(regexp_replace({}, '^file:', ''), '/'), 1, 2), '/')"
PLACES = f"""places AS (SELECT repo_id, id, kind, {PACKAGE.format("CASE WHEN kind = 'File' THEN id ELSE file_id END")} AS package FROM g_nodes
  WHERE kind <> 'External' AND (kind = 'File' OR file_id IS NOT NULL)),
crossing AS (SELECT e.repo_id, s.package AS source, t.package AS target, count(*) AS imports FROM g_edges e
  JOIN places s ON s.repo_id = e.repo_id AND s.id = e.source_id JOIN places t ON t.repo_id = e.repo_id AND t.id = e.target_id
  WHERE e.type = 'IMPORTS' AND s.package <> t.package GROUP BY ALL)"""
DEPENDENTS = f"""{METRICS_SQL}, {HUBS},
walk(repo_id, id, depth) USING KEY (repo_id, id) AS (
  SELECT repo_id, id, 0 FROM hubs
  UNION SELECT DISTINCT w.repo_id, e.source_id, w.depth + 1 FROM walk w JOIN g_nodes k ON k.repo_id = w.repo_id AND k.id = w.id AND k.kind IN {in_list(impact.EXPANDABLE)}
  JOIN g_edges e ON e.repo_id = w.repo_id AND e.target_id = w.id AND e.type <> 'DECLARES' JOIN g_nodes s ON s.repo_id = e.repo_id AND s.id = e.source_id AND s.kind <> 'Route'
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.repo_id = w.repo_id AND r.id = e.source_id))"""


def _on_hubs(operator):
    """An impact operator asked for the hub of each repository."""

    def run(spark, sf_dir):
        graph = load_graph(spark, sf_dir)
        targets = explorer.hubs(graph)
        return operator(graph, impact.dependents(graph, targets), targets)

    return run


def _closure(graph, found, targets):
    return found.drop("via", "target_id")


def _via(graph, found, targets):
    return found.select("repo_id", "id", "via")


_G = {
    "q_declarations": (on_graph(lookup.declarations), f"{GRAPH_SQL} SELECT repo_id, id, kind, name, file_id FROM g_nodes WHERE kind IN {DECL}"),
    "q_enclosing": (
        on_graph(lookup.enclosing),
        f"""{GRAPH_SQL} SELECT e.repo_id, e.target_id AS id, n.id AS enclosing_id, n.kind AS enclosing_kind FROM g_edges e
JOIN g_nodes n ON n.repo_id = e.repo_id AND n.id = e.source_id AND n.kind IN {DECL} WHERE e.type = 'DECLARES'""",
    ),
    "q_references": (on_graph(lookup.references), f"{GRAPH_SQL} {_REF.format(cols='e.type, ', where=_is('<>', 'DECLARES'))}"),
    "q_type_references": (on_graph(lookup.type_references), f"{GRAPH_SQL} {_REF.format(cols='', where=_is('=', 'REFERENCES_TYPE'))}"),
    "q_callers": (on_graph(lookup.callers), f"{GRAPH_SQL} {_REF.format(cols='', where=_is('=', 'CALLS'))}"),
    "q_callees": (
        on_graph(lookup.callees),
        f"""{GRAPH_SQL} SELECT e.repo_id, e.source_id AS id, e.id AS edge_id, e.target_id, n.kind AS target_kind, n.name AS target_name, e.confidence FROM g_edges e
LEFT JOIN g_nodes n ON n.repo_id = e.repo_id AND n.id = e.target_id WHERE e.type = 'CALLS'""",
    ),
    "q_routes": (
        on_graph(lookup.routes),
        f"""{GRAPH_SQL}, c AS (SELECT repo_id, source_id AS id, list(target_id ORDER BY coalesce(ordinal, 0), id) AS h FROM g_edges WHERE type = 'HANDLED_BY' GROUP BY 1, 2)
SELECT n.repo_id, n.id, regexp_extract(n.id, '^route:([^:]+):(.+)$', 1) AS method, regexp_extract(n.id, '^route:([^:]+):(.+)$', 2) AS path, h[-1] AS handler,
  coalesce(h[1:-2], []) AS middleware FROM g_nodes n LEFT JOIN c USING (repo_id, id) WHERE n.kind = 'Route'""",
    ),
    "q_environment_variables": (
        on_graph(lookup.environment_variables),
        f"""{GRAPH_SQL} SELECT n.repo_id, n.id, n.name, e.source_id AS reader, e.id AS edge_id FROM g_nodes n
LEFT JOIN g_edges e ON e.repo_id = n.repo_id AND e.target_id = n.id AND e.type = 'READS' WHERE n.kind = 'EnvironmentVariable'""",
    ),
    "q_dependencies": (
        on_graph(lookup.dependencies),
        f"""{GRAPH_SQL} SELECT n.repo_id, n.id, n.external_kind, n.external_name, e.source_id AS importer, e.id AS edge_id FROM g_nodes n
LEFT JOIN g_edges e ON e.repo_id = n.repo_id AND e.target_id = n.id AND e.type = 'IMPORTS' WHERE n.kind = 'External'""",
    ),
    "q_technologies": (on_graph(lookup.technologies), f"{GRAPH_SQL} SELECT repo_id, container_chain AS region, name, id, category, confidence FROM g_nodes WHERE kind = 'Technology'"),
    "e_explain": (
        on_graph(lookup.explain),
        f"""{GRAPH_SQL}, i AS (SELECT repo_id, target_id AS id, count(*) FILTER (type <> 'DECLARES') AS r, count(*) FILTER (type = 'CALLS') AS c, count(*) FILTER (type = 'REFERENCES_TYPE') AS t FROM g_edges GROUP BY 1, 2),
o AS (SELECT repo_id, source_id AS id, count(*) FILTER (type = 'CALLS') AS c, count(*) FILTER (type = 'READS') AS e, count(*) FILTER (type = 'IMPORTS') AS m FROM g_edges GROUP BY 1, 2)
SELECT n.repo_id, n.id, n.kind, coalesce(i.r, 0) AS "references", coalesce(i.c, 0) AS callers, coalesce(i.t, 0) AS type_references, coalesce(o.c, 0) AS callees,
  coalesce(o.e, 0) AS environment_reads, coalesce(f.m, 0) AS file_imports
FROM g_nodes n LEFT JOIN i USING (repo_id, id) LEFT JOIN o USING (repo_id, id) LEFT JOIN o f ON f.repo_id = n.repo_id AND f.id = n.file_id WHERE n.kind IN {DECL}""",
    ),
    "e_reaching_routes": (
        on_graph(lookup.reaching_routes),
        f"""{GRAPH_SQL} SELECT repo_id, target_id AS id, source_id AS route_id,
CASE WHEN row_number() OVER (PARTITION BY repo_id, source_id ORDER BY coalesce(ordinal, 0) DESC, id DESC) = 1 THEN 'handler' ELSE 'middleware' END AS position
FROM g_edges WHERE type = 'HANDLED_BY'""",
    ),
    "i_dependents": (
        _on_hubs(_closure),
        f"""{RECURSIVE}, {DEPENDENTS} SELECT w.repo_id, w.id, n.kind, w.depth, CASE WHEN w.depth = 1 THEN 'DIRECT' ELSE 'INDIRECT' END AS reach
FROM walk w JOIN g_nodes n USING (repo_id, id) WHERE w.depth > 0""",
    ),
    "i_found_via": (_on_hubs(_via), None),
    "i_routes": (
        _on_hubs(impact.routes_affected),
        f"""{RECURSIVE}, {DEPENDENTS} SELECT w.repo_id, h.id AS target_id, e.source_id AS route_id, w.id, e.id AS edge_id FROM walk w JOIN hubs h ON h.repo_id = w.repo_id
JOIN g_edges e ON e.repo_id = w.repo_id AND e.target_id = w.id AND e.type <> 'DECLARES' JOIN g_nodes r ON r.repo_id = e.repo_id AND r.id = e.source_id AND r.kind = 'Route'""",
    ),
    "i_environment": (
        _on_hubs(impact.environment_affected),
        f"""{RECURSIVE}, {DEPENDENTS} SELECT DISTINCT w.repo_id, h.id AS target_id, e.target_id AS variable_id FROM walk w JOIN hubs h ON h.repo_id = w.repo_id
JOIN g_edges e ON e.repo_id = w.repo_id AND e.source_id = w.id AND e.type = 'READS'""",
    ),
    "i_externals": (
        _on_hubs(impact.externals_affected),
        f"""{RECURSIVE}, {DEPENDENTS}, f AS (SELECT DISTINCT w.repo_id, CASE WHEN n.kind = 'File' THEN n.id ELSE n.file_id END AS file_id FROM walk w JOIN g_nodes n USING (repo_id, id))
SELECT DISTINCT f.repo_id, h.id AS target_id, e.target_id AS external_id FROM f JOIN hubs h ON h.repo_id = f.repo_id
JOIN g_edges e ON e.repo_id = f.repo_id AND e.source_id = f.file_id AND e.type = 'IMPORTS' JOIN g_nodes x ON x.repo_id = e.repo_id AND x.id = e.target_id AND x.kind = 'External'""",
    ),
    "i_statistics": (
        _on_hubs(lambda graph, found, targets: impact.statistics(found, targets)),
        f"""{RECURSIVE}, {DEPENDENTS} SELECT w.repo_id, h.id AS target_id, count(*) FILTER (depth > 0) AS affected, count(*) FILTER (depth = 1) AS direct, max(depth) AS depth
FROM walk w JOIN hubs h ON h.repo_id = w.repo_id GROUP BY 1, 2""",
    ),
    "x_package_imports": (on_graph(explorer.package_imports), f"{GRAPH_SQL}, {PLACES} SELECT * FROM crossing"),
    "x_packages": (
        on_graph(explorer.packages),
        f"""{GRAPH_SQL}, {PLACES} SELECT p.*, (SELECT count(*) FROM crossing c WHERE c.repo_id = p.repo_id AND c.source = p.package) AS dependencies,
(SELECT count(*) FROM crossing c WHERE c.repo_id = p.repo_id AND c.target = p.package) AS dependents
FROM (SELECT repo_id, package, count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind IN {DECL}) AS declarations FROM places GROUP BY 1, 2) p""",
    ),
    "x_files": (
        on_graph(explorer.files),
        f"""{GRAPH_SQL}, p AS (SELECT repo_id, id AS node_id, CASE WHEN kind = 'File' THEN id ELSE file_id END AS id FROM g_nodes),
o AS (SELECT p.repo_id, p.id, count(*) AS edges, count(*) FILTER (e.type = 'IMPORTS' AND t.kind = 'File') AS file_imports, count(*) FILTER (e.type = 'IMPORTS' AND t.kind = 'External') AS external_imports,
  count(DISTINCT CASE WHEN e.type = 'READS' THEN e.target_id END) AS variables
  FROM g_edges e JOIN p ON p.repo_id = e.repo_id AND p.node_id = e.source_id LEFT JOIN g_nodes t ON t.repo_id = e.repo_id AND t.id = e.target_id WHERE p.id IS NOT NULL GROUP BY 1, 2),
d AS (SELECT repo_id, file_id AS id, count(*) AS declarations FROM g_nodes WHERE kind IN {DECL} GROUP BY 1, 2)
SELECT n.repo_id, n.id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('edges', 'file_imports', 'external_imports', 'variables', 'declarations'))}
FROM g_nodes n LEFT JOIN o USING (repo_id, id) LEFT JOIN d USING (repo_id, id) WHERE n.kind = 'File'""",
    ),
    "x_cycles": (on_graph(explorer.all_cycles), None),
    "x_hotspots": (
        on_graph(explorer.hotspots),
        f"""{GRAPH_SQL}, {METRICS_SQL}, u AS ({' UNION ALL '.join([listed('referenced', f'kind IN {DECL}', 'incoming_edges'), listed('coupled', f'kind IN {DECL}', '(incoming_edges + outgoing_edges)'), listed('fan-in', f'kind IN {DECL}', 'fan_in'), listed('fan-out', f'kind IN {DECL}', 'fan_out'), listed('files', "kind = 'File'", '(incoming_edges + outgoing_edges)')])})
SELECT *, row_number() OVER (PARTITION BY repo_id, list ORDER BY value DESC, id) AS position, count(*) OVER (PARTITION BY repo_id, list) AS total FROM u QUALIFY position <= 100""",
    ),
    "x_forward_reach": (
        lambda spark, sf_dir: (lambda g: explorer.forward(g, explorer.hubs(g)))(load_graph(spark, sf_dir)),
        f"""{RECURSIVE}, {METRICS_SQL}, {HUBS}, walk(repo_id, id, depth) USING KEY (repo_id, id) AS (
  SELECT repo_id, id, 0 FROM hubs UNION SELECT DISTINCT w.repo_id, c.target_id, w.depth + 1 FROM walk w JOIN coupling c ON c.repo_id = w.repo_id AND c.source_id = w.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.repo_id = w.repo_id AND r.id = c.target_id)) SELECT * FROM walk""",
    ),
    "x_backward_reach": (
        lambda spark, sf_dir: (lambda g: explorer.backward(g, explorer.hubs(g)))(load_graph(spark, sf_dir)),
        f"""{RECURSIVE}, {METRICS_SQL}, {HUBS}, walk(repo_id, id, depth) USING KEY (repo_id, id) AS (
  SELECT repo_id, id, 0 FROM hubs UNION SELECT DISTINCT w.repo_id, c.source_id, w.depth + 1 FROM walk w JOIN coupling c ON c.repo_id = w.repo_id AND c.target_id = w.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.repo_id = w.repo_id AND r.id = c.source_id)) SELECT * FROM walk""",
    ),
    "x_clusters": (on_graph(explorer.clusters), None),
    "x_search": (
        on_graph(lambda g: explorer.search(g, "load")),
        f"""{GRAPH_SQL}, f AS (SELECT repo_id, id, CASE WHEN kind IN {DECL} THEN 'declarations' WHEN kind = 'File' THEN 'files' WHEN kind = 'Route' THEN 'routes' WHEN kind = 'EnvironmentVariable' THEN 'environment'
  WHEN kind = 'External' THEN 'externals' WHEN kind = 'Technology' THEN 'technologies' WHEN kind IN ('Dependency', 'Manifest') THEN 'dependencies' WHEN kind = 'ArtifactElement' THEN 'artifacts' ELSE 'other' END AS "group"
  FROM g_nodes WHERE starts_with(name, 'load') OR starts_with(id, 'load'))
SELECT *, row_number() OVER (PARTITION BY repo_id, "group" ORDER BY id) AS position, count(*) OVER (PARTITION BY repo_id, "group") AS total FROM f QUALIFY position <= 100""",
    ),
    "x_artifact_inventory": (
        on_graph(explorer.artifact_inventory),
        f"""{GRAPH_SQL}, a AS (SELECT * FROM g_nodes WHERE kind = 'ArtifactElement' AND file_id IS NOT NULL)
SELECT repo_id, artifact_kind, count(DISTINCT file_id) AS files, count(*) AS elements, array_to_string(list_sort(list(DISTINCT file_id))[1:3], ', ') AS examples FROM a GROUP BY 1, 2""",
    ),
}
QUERIES = {k: f for k, (f, _) in _G.items()}
SQL = {k: q for k, (_, q) in _G.items() if q}
