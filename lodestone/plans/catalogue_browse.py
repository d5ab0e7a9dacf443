"""Queries on what one looks at of repositories, packages, files and declarations, and their SQL; lists as JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import browse
from lodestone.plans.catalogue_graph import PLACES
from lodestone.plans.graph import GRAPH_SQL, MODULE_SQL, load_graph

_DECL = "('Class', 'Interface', 'TypeAlias', 'Enum', 'EnumMember', 'Function', 'Method', 'Property', 'Accessor', 'Constructor', 'Variable', 'Namespace')"


def _told(operator):
    def run(spark, sf_dir):
        df = operator(load_graph(spark, sf_dir))
        return df.select(*[F.to_json(c).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])

    return run


def _list(name: str, rows: str, key: str = "id") -> str:
    """A CTE of lists; rows: repo_id, the key and entry."""
    return f"""l_{name} AS (SELECT repo_id, {key}, count(*) AS n_{name}, CAST(to_json(list(entry ORDER BY entry)[1:100]) AS VARCHAR) AS {name}
  FROM (SELECT DISTINCT * FROM ({rows}) WHERE entry IS NOT NULL) GROUP BY 1, 2)"""


def _with(base: str, key: str, columns: str, lists: dict[str, str]) -> str:
    parts = ", ".join(_list(n, rows, key) for n, rows in lists.items())
    joins = " ".join(f"LEFT JOIN l_{n} USING (repo_id, {key})" for n in lists)
    return f"{parts}, base AS ({base}) SELECT {columns}, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}, coalesce({n}, chr(91) || chr(93)) AS {n}' for n in lists)} FROM base {joins}"


def _edges(kind: str, key: str, entry: str) -> str:
    return f"SELECT repo_id, {key} AS id, {entry} AS entry FROM g_edges WHERE type = '{kind}'"


_ENTRIES = {
    "x_overview": (
        browse.overview,
        f"""{GRAPH_SQL}, n AS (SELECT repo_id, count(*) AS nodes, count(*) FILTER (kind IN {_DECL}) AS declarations, count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind = 'Route') AS routes,
  count(*) FILTER (kind = 'EnvironmentVariable') AS variables, count(*) FILTER (kind = 'External') AS externals, count(*) FILTER (kind = 'Technology') AS technologies, count(*) FILTER (kind = 'Dependency') AS dependencies
  FROM g_nodes GROUP BY 1),
e AS (SELECT repo_id, count(*) AS edges, count(*) FILTER (confidence = 'CERTAIN') AS certain, count(*) FILTER (confidence = 'RESOLVED') AS resolved,
  count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM g_edges GROUP BY 1)
SELECT n.*, coalesce(edges, 0) AS edges, coalesce(certain, 0) AS certain, coalesce(resolved, 0) AS resolved, coalesce(inferred, 0) AS inferred, coalesce(ambiguous, 0) AS ambiguous FROM n LEFT JOIN e USING (repo_id)""",
    ),
    "x_browse_symbols": (
        browse.symbols,
        f"{GRAPH_SQL}, "
        + _with(
            f"""SELECT n.repo_id, n.id, n.kind, n.name, n.file_id, p.parent_id FROM g_nodes n
  LEFT JOIN (SELECT repo_id, target_id AS id, min(source_id) AS parent_id FROM g_edges WHERE type = 'DECLARES' GROUP BY 1, 2) p USING (repo_id, id) WHERE n.kind IN {_DECL}""",
            "id",
            "repo_id, id, kind, name, file_id, parent_id",
            {
                "members": _edges("DECLARES", "source_id", "target_id"),
                "callers": _edges("CALLS", "target_id", "source_id"),
                "callees": _edges("CALLS", "source_id", "target_id"),
                "referrers": "SELECT repo_id, target_id AS id, source_id AS entry FROM g_edges WHERE type NOT IN ('DECLARES', 'CONTAINS')",
                "variables": _edges("READS", "source_id", "target_id"),
            },
        ),
    ),
    "x_browse_files": (
        browse.files,
        f"{GRAPH_SQL}, {MODULE_SQL}, "
        + _with(
            "SELECT repo_id, id, array_to_string(list_slice(string_split(regexp_replace(id, '^file:', ''), '/'), 1, 2), '/') AS package FROM g_nodes WHERE kind = 'File'",
            "id",
            "repo_id, id, package",
            {
                "declarations": f"SELECT repo_id, file_id AS id, id AS entry FROM g_nodes WHERE kind IN {_DECL}",
                "imports": _edges("IMPORTS", "source_id", "target_id"),
                "exports": _edges("EXPORTS", "source_id", "target_id"),
                "importers": "SELECT repo_id, target_id AS id, source_id AS entry FROM modules",
            },
        ),
    ),
    "x_browse_packages": (
        browse.packages,
        f"{GRAPH_SQL}, {PLACES}, "
        + _with(
            "SELECT DISTINCT repo_id, package FROM places WHERE kind = 'File'",
            "package",
            "repo_id, package",
            {
                "files": "SELECT repo_id, package, id AS entry FROM places WHERE kind = 'File'",
                "exported": f"SELECT p.repo_id, p.package, p.id AS entry FROM places p JOIN g_nodes n USING (repo_id, id) WHERE n.kind IN {_DECL} AND n.is_exported",
                "needs": "SELECT repo_id, source AS package, target AS entry FROM crossing",
                "needed_by": "SELECT repo_id, target AS package, source AS entry FROM crossing",
            },
        ),
    ),
    "q_neighbours": (
        browse.neighbours,
        f"""{GRAPH_SQL} SELECT repo_id, id, type, sum(o) AS outgoing, sum(i) AS incoming FROM (
  SELECT repo_id, source_id AS id, type, 1 AS o, 0 AS i FROM g_edges UNION ALL SELECT repo_id, target_id, type, 0, 1 FROM g_edges) GROUP BY 1, 2, 3""",
    ),
}

QUERIES = {k: _told(f) for k, (f, _) in _ENTRIES.items()}
SQL = {k: q for k, (_, q) in _ENTRIES.items()}
