"""Queries on sources, regions, artefacts, construction, ranking, facts and quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.vocabulary import CONFIDENCES, DECLARATIONS, ECOSYSTEMS, ENDPOINTS
from lodestone.operators import artifacts, binding, construct, navigation, quality, regions, retrieval, technology
from lodestone.operators.health import kind_counts
from lodestone.plans.catalogue_graph import PLACES
from lodestone.plans.catalogue_health import DECL, METRICS_SQL, RECURSIVE, on_graph
from lodestone.plans.graph import GRAPH_SQL, in_list, load_graph
from lodestone.plans.standing import standing
from lodestone.sources import store
from lodestone.sources.tables import table


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing files; of equal times the one whose contents have the greater hash."""
    files = table(spark, sf_dir, "repo_files").select("repo_id", "file_id", "path", "bytes", "contents", "scanned_at")
    return standing(files, ["repo_id", "file_id"], "scanned_at", [F.xxhash64("contents").desc()])


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repo_files").select("repo_id", "path").where("path is not null").distinct()


def anchors(files: DataFrame) -> DataFrame:
    """The data has no manifests under their usual names: directories that hold a JSON file stand for them."""
    return files.where("path like '%.json'").select("repo_id", paths.directory(F.col("path")).alias("region")).distinct()


def s_classified(spark, sf_dir):
    return regions.classified(file_paths(spark, sf_dir))


def r_regions(spark, sf_dir):
    files = file_paths(spark, sf_dir)
    return regions.regions(files, anchors(files))


def r_region_languages(spark, sf_dir):
    files = file_paths(spark, sf_dir)
    return regions.region_languages(files, anchors(files))


def r_capabilities(spark, sf_dir):
    """Regions with code of a language that a graph covers count as semantic, others as discovered."""
    languages = r_region_languages(spark, sf_dir)
    depth = F.when(F.col("language").isin("typescript", "javascript", "python", "java", "go"), "semantic").otherwise("discovered")
    return regions.capabilities(languages.select("repo_id", "region", depth.alias("depth")), languages)


def k_fingerprint(spark, sf_dir):
    return store.fingerprint(repo_files(spark, sf_dir).select("repo_id", "path", "bytes", F.col("scanned_at").alias("modified")))


def a_families(spark, sf_dir):
    files = repo_files(spark, sf_dir)
    return artifacts.families(files.select("repo_id", "path", "contents")).groupBy("repo_id", "family").agg(F.count(F.lit(1)).alias("files"))


def a_elements(spark, sf_dir):
    return artifacts.elements(repo_files(spark, sf_dir))


def a_entities(spark, sf_dir):
    return a_elements(spark, sf_dir).where("family = 'schema' and kind = 'entity'").select("repo_id", "path", "name")


def a_environment_names(spark, sf_dir):
    named = repo_files(spark, sf_dir).select("repo_id", "path", F.explode(artifacts.environment_names(F.col("contents"))).alias("name"))
    return named.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("files"))


def t_technologies(spark, sf_dir):
    files = repo_files(spark, sf_dir)
    return technology.detect(files.select("repo_id", "path", "contents"), regions.regions(files.select("repo_id", "path"), anchors(files)))


def _declarations(graph):
    chain = F.split(F.coalesce("container_chain", "name"), r"\.")
    return graph.nodes.where(F.col("kind").isin(*DECLARATIONS) & F.col("file_id").isNotNull()).select("repo_id", "id", "file_id", "kind", "name", chain.alias("chain"))


def _inherited(graph):
    extends = graph.of_type("EXTENDS", "IMPLEMENTS").select("repo_id", F.col("source_id").alias("child_id"), F.col("target_id").alias("parent_id"))
    return binding.inherited_members(_declarations(graph), extends)


def _bind_rates(graph):
    """An edge that stayed ambiguous counts as not resolved."""
    return quality.bind_rates(graph.edges.where("confidence != 'AMBIGUOUS'"), graph.edges.where("confidence = 'AMBIGUOUS'"))


def _projection(graph):
    """Facts of each repository in order of part and text, into the standard tier, no part with more than half of it."""
    order = ["part", "subject", "predicate", "object"]
    return retrieval.projected(retrieval.facts(graph), retrieval.TIERS["standard"], group=["repo_id"], order=order, share=0.5).select("repo_id", "fact_id", *order, "cost", "upto")


def _omissions(graph):
    all_facts = retrieval.facts(graph)
    order = ["part", "subject", "predicate", "object"]
    kept = retrieval.projected(all_facts, retrieval.TIERS["standard"], group=["repo_id"], order=order, share=0.5)
    return retrieval.omissions(all_facts, kept, ["repo_id"])


def _scale(graph):
    sizes = kind_counts(graph).groupBy("repo_id").agg(F.sum(F.when(F.col("kind") == "File", F.col("nodes"))).alias("files"), F.sum(F.when(F.col("kind").isin("Technology", "Route"), F.col("nodes"))).alias("nameable"))
    return sizes.withColumn("scale", retrieval.scale(F.col("files"), F.col("nameable")))


def _package_reach(graph):
    return navigation.group_reach(graph, navigation.largest_packages(graph))


def c_grounding(spark, sf_dir):
    """Documents as answers, the graph of their repository as facts: identifiers that no node has."""
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), "text", "repo_id")
    named = answers.select("answer_id", "repo_id", F.explode(retrieval.identifiers(F.col("text"))).alias("subject"))
    nodes = load_graph(spark, sf_dir).nodes.select("repo_id", F.col("id").alias("subject"))
    known = named.join(nodes, ["repo_id", "subject"]).select("answer_id", F.lit("f1").alias("fact_id"), "subject", F.lit("").alias("object"))
    return retrieval.grounding(answers.select("answer_id", "text"), known)


def c_claims(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), "text")
    none = spark.createDataFrame([], "answer_id bigint, predicate string")
    return retrieval.claims(answers, none)


_STANDING_PATHS = "WITH p AS (SELECT DISTINCT repo_id, path FROM repo_files WHERE path IS NOT NULL)"


def _map(table_: dict[str, str], key: str) -> str:
    return f"element_at(MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in table_.items())}}}, {key})[1]"


_BY_EXTENSION = {e: language for language, es in paths.EXTENSIONS.items() for e in es.split()}
_CLASSIFIED = f"""{_STANDING_PATHS}, n AS (SELECT *, lower(string_split(path, '/')[-1]) AS name, string_split(lower(path), '/')[1:-2] AS dirs FROM p),
e AS (SELECT *, CASE WHEN starts_with(name, 'dockerfile.') THEN 'dockerfile' ELSE coalesce({_map(paths.NAMES, 'name')}, {_map(_BY_EXTENSION, "regexp_extract(name, '[.]([^.]+)$', 1)")}) END AS language,
  CASE WHEN name LIKE '%.csproj' OR name LIKE '%.fsproj' THEN 'nuget' ELSE {_map(paths.MANIFESTS, 'name')} END AS ecosystem, regexp_replace(name, '[.][^.]*$', '') AS stem FROM n),
c AS (SELECT repo_id, path, language, CASE WHEN ecosystem IS NOT NULL THEN 'manifest' WHEN name IN {in_list([*paths.LOCKFILES, *paths.BUILD])} THEN 'build'
  WHEN name IN {in_list(paths.INFRASTRUCTURE)} OR coalesce(language IN ('dockerfile', 'terraform'), false) THEN 'infrastructure'
  WHEN list_has_any(dirs, {list(paths.TEST_DIRS)}) OR regexp_matches(stem, '([.]test|[.]spec|test|tests)$|^test_|^conftest$') THEN 'test'
  WHEN list_has_any(dirs, {list(paths.INFRASTRUCTURE_DIRS)}) THEN 'infrastructure' WHEN coalesce(language = 'markdown', false) OR list_has_any(dirs, {list(paths.DOC_DIRS)}) THEN 'documentation'
  WHEN language IS NULL THEN 'other' WHEN language IN {in_list(paths.CONFIGURATION)} THEN 'configuration' WHEN language IN {in_list(paths.PROGRAMMING)} THEN 'source' ELSE 'other' END AS role, ecosystem FROM e)"""
_DIRECTORY = "CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[1:-2], '/') ELSE '.' END"
_REGIONS = f"""anchors AS (SELECT DISTINCT repo_id, {_DIRECTORY} AS region FROM p WHERE path LIKE '%.json'),
placed AS (SELECT p.repo_id, p.path, coalesce(max_by(a.region, length(a.region)) FILTER (a.region <> '.'), '.') AS region FROM p
  LEFT JOIN anchors a ON a.repo_id = p.repo_id AND starts_with({_DIRECTORY.replace('path', 'p.path')} || '/', a.region || '/') GROUP BY 1, 2)"""
_LANGUAGES = """counted AS (SELECT repo_id, region, language, count(*) AS files, count(*) FILTER (role = 'source') AS sources FROM c JOIN placed USING (repo_id, path) WHERE language IS NOT NULL GROUP BY 1, 2, 3),
spoken AS (SELECT repo_id, region, language, files, row_number() OVER (PARTITION BY repo_id, region ORDER BY files DESC, language) AS position,
  row_number() OVER (PARTITION BY repo_id, region ORDER BY sources DESC, language) = 1 AND sources > 0 AS is_primary FROM counted)"""
_ROLES = f"""top AS (SELECT repo_id, id AS node_id, name, regexp_replace(file_id, '^file:', '') AS path FROM g_nodes WHERE kind IN ('Class', 'Function', 'Variable') AND file_id IS NOT NULL
  AND (container_chain IS NULL OR NOT contains(container_chain, '.'))),
dirs AS (SELECT *, string_split(path, '/')[1:-2] AS d FROM top),
roles AS ({' UNION ALL '.join(f"SELECT repo_id, node_id, '{r}' AS role, CASE WHEN {' OR '.join(f'suffix(name, {chr(39)}{s}{chr(39)})' for s in ss)} THEN 'name' ELSE 'directory' END AS evidence FROM dirs WHERE {' OR '.join(f'suffix(name, {chr(39)}{s}{chr(39)})' for s in ss)} OR list_has_any(d, {ds})" for r, ss, ds in retrieval.CONVENTIONS)}
  UNION ALL SELECT repo_id, node_id, 'Test', 'file' FROM dirs WHERE list_has_any(d, {retrieval.TEST_DIRS}) OR regexp_matches(path, '[.](test|spec)[.][cm]?tsx?$'))"""


def _region_role(path: str) -> str:
    """The role of a path; every word as TESTDATA's paths and the statement of the rule have it."""
    segments = f"string_split(lower({path}), '/')"
    top = f"lower(string_split({path}, '/')[1])"
    parted = f"lower(regexp_replace(string_split({path}, '/')[1], '([a-z0-9])([A-Z])', '\\1-\\2', 'g'))"
    samples = "sample|samples|starter|starters|template|templates|cookbook|cookbooks|recipe|recipes|tutorial|tutorials|walkthrough|walkthroughs|lab|labs|kata|katas|exercise|exercises"
    ends = "sample|samples|architecture|architectures|practice|practices|tutorial|tutorials|example|examples|demo|demos|lab|labs|walkthrough|walkthroughs"
    prose = "wiki|guide|guides|manual|handbook|article|articles|blog|notebook|notebooks"

    def tops(pattern: str) -> str:
        return f"(regexp_full_match({top}, '{pattern}') OR regexp_full_match({parted}, '{pattern}'))"

    def any_of(words: str, dot: bool = True) -> str:
        return f"len(list_filter({segments}, lambda s: regexp_full_match(s, '{'[.]?' if dot else ''}({words})([_-][a-z0-9_-]+)?'))) > 0"

    return f"""CASE WHEN list_has_any({segments}, ['dist', 'build', 'out', 'target', 'lib-esm', 'coverage']) THEN 'generated'
  WHEN {tops(samples)} OR {tops(f'[a-z0-9_]+[_-]({ends})')} THEN 'sample' WHEN {tops('[a-z0-9_]*[_-]?deployments?')} THEN 'deployment' WHEN {tops(prose)} THEN 'documentation'
  WHEN {any_of('generated|gen|__generated__|[.]next|flow-typed|typings|@types')} THEN 'generated' WHEN {any_of('node_modules|vendor|vendored|third_party|thirdparty|submodule|submodules')} THEN 'vendored'
  WHEN {any_of('ci|github|circleci|gitlab-ci|azure-pipelines|azure_pipelines|travis|jenkins|buildkite|appveyor|woodpecker|drone')} THEN 'ci' WHEN {any_of('benchmark|benchmarks|bench|performance')} THEN 'benchmark'
  WHEN {any_of('example|examples|demo|demos|playground')} THEN 'example' WHEN {any_of('test|tests|testing|__tests__|spec|specs|testdata|fixture|fixtures|e2e')} THEN 'test'
  WHEN {any_of('doc|docs|website|documentation|image|images|asset|assets|media|screenshot|screenshots')} THEN 'documentation'
  WHEN {any_of('deploy|deployment|deployments|infra|infrastructure|terraform|helm|chart|charts|k8s|kubernetes|ansible|pulumi|cloudformation')} THEN 'deployment'
  WHEN {any_of('migration|migrations|alembic|liquibase|flyway')} THEN 'migration' WHEN {any_of('[.]vscode|[.]idea|[.]devcontainer|[.]husky|config|configs|conf', False)} THEN 'configuration'
  WHEN {any_of('script|scripts|tooling|automation')} THEN 'script' ELSE 'production' END"""


_SIGNALS = f"""{METRICS_SQL}, {_ROLES}, {PLACES},
good AS (SELECT repo_id, id FROM g_nodes WHERE kind IN {DECL} AND file_id IS NOT NULL AND {_region_role("regexp_replace(file_id, '^file:', '')")} = 'production'),
packs AS (SELECT p.repo_id, p.package, count(*) FILTER (kind IN {DECL}) AS d, (SELECT count(*) FROM crossing c WHERE c.repo_id = p.repo_id AND c.target = p.package) AS n FROM places p GROUP BY 1, 2),
s AS (
  SELECT repo_id, id, 'declaration' AS kind, 'fan-in' AS signal, fan_in::DOUBLE AS value FROM metrics JOIN good USING (repo_id, id)
  UNION ALL SELECT repo_id, id, 'declaration', 'coupling', fan_in + fan_out FROM metrics JOIN good USING (repo_id, id)
  UNION ALL SELECT repo_id, target_id, 'declaration', 'route-ownership', count(*) FROM (SELECT * FROM g_edges WHERE type = 'HANDLED_BY' QUALIFY row_number() OVER (PARTITION BY repo_id, source_id ORDER BY coalesce(ordinal, 0) DESC, id DESC) = 1) h
    WHERE (repo_id, target_id) IN (SELECT (repo_id, id) FROM good) GROUP BY 1, 2
  UNION ALL SELECT r.repo_id, r.node_id, 'declaration', 'role', max({_map({k: str(v) for k, v in retrieval.ROLE_WEIGHTS.items()}, 'r.role')}::DOUBLE) FROM roles r JOIN good g ON g.repo_id = r.repo_id AND g.id = r.node_id GROUP BY 1, 2
  UNION ALL SELECT repo_id, package, 'package', 'dependents', n FROM packs UNION ALL SELECT repo_id, package, 'package', 'size', d FROM packs),
k AS (SELECT *, max(value) OVER (PARTITION BY repo_id, kind, signal) AS peak FROM s WHERE value > 0),
scored AS (SELECT repo_id, kind, id, sum(value / peak * {_map({k: str(v) for k, v in retrieval.WEIGHTS.items()}, 'signal')}::DOUBLE) / CASE kind WHEN 'package' THEN 0.18 ELSE 0.89 END AS raw, count(*) AS signals FROM k GROUP BY 1, 2, 3)"""
_TREE = f"""places2 AS (SELECT repo_id, id, file_id, kind, {"array_to_string(list_slice(string_split(regexp_replace(file_id, '^file:', ''), '/'), 1, 2), '/')"} AS package FROM g_nodes WHERE kind IN {DECL} AND file_id IS NOT NULL)"""
_MEMBERS = f"""d AS (SELECT repo_id, id, file_id, kind, name, string_split(coalesce(container_chain, name), '.') AS chain FROM g_nodes WHERE kind IN {DECL} AND file_id IS NOT NULL)"""

_CLAIMS = r"""WITH parts AS (
  SELECT doc_id AS answer_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z`"''\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 12) AS ss
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT answer_id, i - 1 AS position, ss[i] AS sentence, ' ' || trim(regexp_replace(lower(ss[i]), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS w
  FROM parts, unnest(range(1, len(ss) + 1)) AS t(i)),
k AS (SELECT *, CASE
  WHEN regexp_matches(w, ' (there (is|are) no|(has|have) no|(does|do) not (have|use|contain|implement)|lacks|without any) ') THEN 'absence-as-nonexistence'
  WHEN regexp_matches(w, ' (well (documented|tested|structured|organised|organized|maintained|architected|factored)|best (practice|practices)|(standard|modern) conventions|(high|good|excellent|poor|low) (quality|test coverage)|clean architecture|idiomatic (code|structure)|production ready|thoroughly (tested|documented)) ') THEN 'presence-as-quality'
  WHEN regexp_matches(w, '^ (start|begin|read|open|look at) ') OR regexp_matches(w, ' ((you|readers|newcomers|anyone new|someone new) (should|could|can|will want to|would want to) (start|begin|read|open|look at)|recommend (starting|beginning|reading)|place to start|starting point|start (here|by reading|with the)) ') THEN 'recommendation-without-evidence'
  WHEN regexp_matches(w, ' (the (core|centre|center|heart|hub|backbone|foundation|linchpin)|(as|is) the (core|heart|backbone|foundation) of|most important|the (central|key|main|primary) (component|module|piece|abstraction)|architecturally central|(serves|acts) as (a|the) (bridge|hub|backbone)) ') THEN 'prominence-as-importance'
  WHEN regexp_matches(w, ' ((begin|begins|start|starts) (with|at|from|by)|then (call|calls|invokes|runs|passes|hands)|first (calls|runs|invokes)|followed by|next (it|the)|triggers?|kicks off|orchestrates?|before|after|precedes?) ') THEN 'execution-order'
  WHEN regexp_matches(w, ' (authenticate|authenticates|authenticated|authentication|authori[sz](e|es|ed|ation)|logs? in|logged in|login flow|sign in|access control|permissions?|identity provider) ') THEN 'secrets-as-authentication'
  WHEN regexp_matches(w, ' (caches|persists|stores (data|its data)|queues|validates|(is )?responsible for|handles (requests|errors|events)) ') THEN 'presence-as-behaviour'
  WHEN regexp_matches(w, ' (runs? (on|in|every|nightly|daily)|is deployed to|deploys? to|executes? (on|when)|is scheduled) ') THEN 'configuration-as-runtime' END AS kind
  FROM s WHERE NOT regexp_matches(w, ' not (established|observed|recorded|detected|determined|confirmed|found|identified) '))
SELECT answer_id, position, sentence, kind,
  CASE WHEN regexp_matches(w, ' (may|might|could|would|(appears?|seems?) (to|that)|suggests?|likely|probably|possibly|presumably|apparently) ') THEN 'inferred' ELSE 'unsupported' END AS strength
FROM k WHERE kind IS NOT NULL"""
_B = {
    "s_classified": (s_classified, f"{_CLASSIFIED} SELECT * FROM c"),
    "r_regions": (r_regions, f"{_STANDING_PATHS}, {_REGIONS} SELECT * FROM placed"),
    "r_region_languages": (r_region_languages, f"{_CLASSIFIED}, {_REGIONS}, {_LANGUAGES} SELECT * FROM spoken"),
    "r_capabilities": (
        r_capabilities,
        f"""{_CLASSIFIED}, {_REGIONS}, {_LANGUAGES} SELECT repo_id, count(DISTINCT language) AS languages, CAST(sum(files) AS BIGINT) AS files, count(DISTINCT language) FILTER (is_primary) > 1 AS polyglot,
CASE WHEN bool_or(language IN ('typescript', 'javascript', 'python', 'java', 'go')) THEN 'semantic' ELSE 'discovered' END AS depth FROM spoken GROUP BY 1""",
    ),
    "k_fingerprint": (k_fingerprint, None),
    "a_families": (a_families, None),
    "a_elements": (a_elements, None),
    "a_entities": (
        a_entities,
        """SELECT DISTINCT repo_id, path, unnest(regexp_extract_all(contents, '(?im)^\\s*create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w.]+)', 1)) AS name
FROM (SELECT * FROM repo_files QUALIFY row_number() OVER (PARTITION BY repo_id, file_id ORDER BY scanned_at DESC) = 1) WHERE path LIKE '%.sql'""",
    ),
    "a_environment_names": (a_environment_names, None),
    "t_technologies": (t_technologies, None),
    "g_declares": (
        on_graph(construct.declares),
        f"""{GRAPH_SQL}, {_MEMBERS}, x AS (SELECT repo_id, id, file_id, chain, unnest(range(1, len(chain))) AS n FROM d),
f AS (SELECT x.repo_id, x.id, max_by(o.id, x.n) AS parent_id FROM x JOIN (SELECT repo_id, file_id, array_to_string(chain, '.') AS path, min(id) AS id FROM d GROUP BY 1, 2, 3) o
  ON o.repo_id = x.repo_id AND o.file_id = x.file_id AND o.path = array_to_string(x.chain[1:x.n], '.') GROUP BY 1, 2)
SELECT d.repo_id, d.id, coalesce(f.parent_id, d.file_id) AS parent_id FROM d LEFT JOIN f USING (repo_id, id)""",
    ),
    "g_externals": (
        on_graph(lambda g: construct.minted_externals(g.edges)),
        f"""{GRAPH_SQL} SELECT repo_id, target_id AS id, {CONFIDENCES}[min(list_position({CONFIDENCES}, confidence))] AS confidence, count(*) AS edges
FROM g_edges WHERE starts_with(target_id, 'ext:') GROUP BY 1, 2""",
    ),
    "g_violations": (
        on_graph(lambda g: construct.violations(g).groupBy("repo_id", "rule").agg(F.count(F.lit(1)).alias("n"))),
        f"""{GRAPH_SQL}, files AS (SELECT repo_id, id FROM g_nodes WHERE kind = 'File'), rules(type, s, t) AS (VALUES {', '.join(f"('{t}', '{s}', '{e}')" for t, (ss, es) in ENDPOINTS.items() for s in ss for e in es)}),
v AS (
  SELECT repo_id, 'node-id-twice' AS rule FROM g_nodes GROUP BY repo_id, id HAVING count(*) > 1
  UNION ALL SELECT repo_id, 'edge-id-twice' FROM g_edges GROUP BY repo_id, id HAVING count(*) > 1
  UNION ALL SELECT repo_id, 'file-missing' FROM g_nodes WHERE file_id IS NOT NULL AND (repo_id, file_id) NOT IN (SELECT (repo_id, id) FROM files)
  UNION ALL SELECT repo_id, 'provenance-file-missing' FROM g_edges WHERE provenance_file IS NOT NULL AND (repo_id, provenance_file) NOT IN (SELECT (repo_id, id) FROM files)
  UNION ALL SELECT repo_id, 'source-missing' FROM g_edges WHERE (repo_id, source_id) NOT IN (SELECT (repo_id, id) FROM g_nodes)
  UNION ALL SELECT repo_id, 'target-missing' FROM g_edges WHERE (repo_id, target_id) NOT IN (SELECT (repo_id, id) FROM g_nodes)
  UNION ALL SELECT e.repo_id, 'ends-not-allowed' FROM g_edges e JOIN g_nodes s ON s.repo_id = e.repo_id AND s.id = e.source_id JOIN g_nodes t ON t.repo_id = e.repo_id AND t.id = e.target_id
    WHERE (e.type, s.kind, t.kind) NOT IN (SELECT (type, s, t) FROM rules))
SELECT repo_id, rule, count(*) AS n FROM v GROUP BY 1, 2""",
    ),
    "b_inherited_members": (
        on_graph(_inherited),
        f"""{RECURSIVE}, {_MEMBERS}, owners AS (SELECT repo_id, file_id, array_to_string(chain, '.') AS path, id FROM d WHERE kind IN ('Class', 'Interface', 'Enum', 'Namespace')),
own AS (SELECT d.repo_id, o.id, d.name, d.id AS member_id FROM d JOIN owners o ON o.repo_id = d.repo_id AND o.file_id = d.file_id AND o.path = array_to_string(d.chain[1:-2], '.') WHERE len(d.chain) > 1),
walk(repo_id, class_id, id, depth) USING KEY (repo_id, class_id, id) AS (
  SELECT repo_id, id, id, 0 FROM owners UNION SELECT DISTINCT w.repo_id, w.class_id, e.target_id, w.depth + 1 FROM walk w JOIN g_edges e ON e.repo_id = w.repo_id AND e.source_id = w.id AND e.type IN ('EXTENDS', 'IMPLEMENTS')
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.repo_id = w.repo_id AND r.class_id = w.class_id AND r.id = e.target_id))
SELECT w.repo_id, w.class_id, m.name, m.member_id, w.depth FROM walk w JOIN own m ON m.repo_id = w.repo_id AND m.id = w.id
QUALIFY row_number() OVER (PARTITION BY w.repo_id, w.class_id, m.name ORDER BY w.depth, m.member_id) = 1""",
    ),
    "f_roles": (on_graph(retrieval.roles), f"{GRAPH_SQL}, {_ROLES} SELECT * FROM roles"),
    "c_importance": (
        on_graph(retrieval.importance),
        f"""{GRAPH_SQL}, {_SIGNALS}, r AS (SELECT repo_id, kind, id, floor(raw * 1000 + 0.5) / 1000 AS score, signals FROM scored)
SELECT *, CASE WHEN score >= 0.75 THEN 5 WHEN score >= 0.5 THEN 4 WHEN score >= 0.3 THEN 3 WHEN score >= 0.15 THEN 2 ELSE 1 END AS stars,
  row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, signals DESC, id) AS position FROM r""",
    ),
    "c_areas": (
        on_graph(retrieval.areas),
        f"""{GRAPH_SQL}, f AS (SELECT repo_id, regexp_replace(id, '^file:', '') AS path FROM g_nodes WHERE kind = 'File')
SELECT repo_id, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS area, count(*) AS files,
  floor(CAST(count(*) FILTER ({_region_role('path')} = 'production') AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS production FROM f GROUP BY 1, 2""",
    ),
    "c_scale": (
        on_graph(_scale),
        f"""{GRAPH_SQL}, n AS (SELECT repo_id, count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind IN ('Technology', 'Route')) AS nameable FROM g_nodes GROUP BY 1)
SELECT *, ['small', 'medium', 'large', 'huge'][greatest(CASE WHEN files <= 250 THEN 1 WHEN files <= 2000 THEN 2 WHEN files <= 10000 THEN 3 ELSE 4 END, CASE WHEN nameable <= 78 THEN 1 WHEN nameable <= 312 THEN 2 WHEN nameable <= 1248 THEN 3 ELSE 4 END)] AS scale FROM n""",
    ),
    "c_capabilities": (on_graph(retrieval.capabilities), None),
    "c_route_groups": (
        on_graph(retrieval.route_groups),
        f"""{GRAPH_SQL}, r AS (SELECT repo_id, regexp_extract(id, '^route:([^:]+):(.+)$', 1) AS m, list_filter(string_split(regexp_extract(id, '^route:([^:]+):(.+)$', 2), '/'), lambda x : x <> '') AS s FROM g_nodes WHERE kind = 'Route')
SELECT repo_id, '/' || coalesce(s[1], '') AS prefix, count(*) AS routes, array_to_string(list_sort(list(DISTINCT m)), ' ') AS methods FROM r GROUP BY 1, 2""",
    ),
    "c_external_families": (
        on_graph(retrieval.external_families),
        f"""{GRAPH_SQL}, x AS (SELECT repo_id, external_kind, external_name AS n FROM g_nodes WHERE kind = 'External' AND external_kind IN {in_list(ECOSYSTEMS)} AND external_name IS NOT NULL)
SELECT repo_id, external_kind, CASE WHEN starts_with(n, '@') THEN string_split(n, '/')[1] WHEN strpos(n, ':') > 1 THEN string_split(n, ':')[1] WHEN contains(n, '/') THEN array_to_string(string_split(n, '/')[1:2], '/')
  WHEN len(string_split(n, '.')) > 2 THEN array_to_string(string_split(n, '.')[1:-2], '.') ELSE n END AS family, count(*) AS members FROM x GROUP BY 1, 2, 3""",
    ),
    "c_projection": (on_graph(_projection), None),
    "c_omissions": (on_graph(_omissions), None),
    "c_grounding": (c_grounding, None),
    "c_claims": (c_claims, _CLAIMS),
    "m_confidences": (
        on_graph(quality.confidences),
        f"{GRAPH_SQL} SELECT repo_id, type, {', '.join(f'count(*) FILTER (confidence = {chr(39)}{c}{chr(39)}) AS {c.lower()}' for c in CONFIDENCES)} FROM g_edges GROUP BY 1, 2",
    ),
    "m_bind_rates": (
        on_graph(_bind_rates),
        f"""{GRAPH_SQL} SELECT repo_id, type, count(*) FILTER (confidence <> 'AMBIGUOUS') AS resolved, count(*) FILTER (confidence = 'AMBIGUOUS') AS unresolved,
CAST(count(*) FILTER (confidence <> 'AMBIGUOUS') AS DOUBLE) / count(*) AS rate FROM g_edges GROUP BY 1, 2""",
    ),
    "m_target_reach": (
        on_graph(quality.target_reach),
        f"""{GRAPH_SQL}, c AS (SELECT repo_id, target_id AS t, regexp_matches(target_id, '^ext:[^:]+$') OR starts_with(target_id, 'ext:outside-analysis') AS opaque FROM g_edges WHERE type = 'CALLS')
SELECT repo_id, count(*) FILTER (NOT starts_with(t, 'ext:')) AS internal, count(*) FILTER (starts_with(t, 'ext:') AND NOT opaque) AS named, count(*) FILTER (opaque) AS opaque FROM c GROUP BY 1""",
    ),
    "n_tree": (on_graph(navigation.tree), f"{GRAPH_SQL}, {_TREE} SELECT repo_id, package, file_id, kind, count(*) AS declarations FROM places2 GROUP BY ALL"),
    "n_package_reach": (
        on_graph(_package_reach),
        f"""{RECURSIVE}, {METRICS_SQL}, {_TREE}, best AS (SELECT repo_id, package FROM places2 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, package) = 1),
walk(repo_id, "group", id, depth) USING KEY (repo_id, id) AS (
  SELECT p.repo_id, p.package, p.id, 0 FROM places2 p JOIN best USING (repo_id, package)
  UNION SELECT DISTINCT w.repo_id, w."group", c.target_id, w.depth + 1 FROM walk w JOIN coupling c ON c.repo_id = w.repo_id AND c.source_id = w.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.repo_id = w.repo_id AND r.id = c.target_id)) SELECT * FROM walk WHERE depth > 0""",
    ),
    "n_package_levels": (on_graph(navigation.package_levels), None),
    "n_route_explanations": (on_graph(navigation.explain_routes), None),
}
QUERIES = {k: f for k, (f, _) in _B.items()}
SQL = {k: q for k, (_, q) in _B.items() if q}
