"""Operators that work on facts which the data doesn't hold: small fixtures."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.values import instant_us
from lodestone.operators import artifacts, binding, construct, framework, quality, regions, retrieval, technology
from lodestone.plans.graph import Graph
from lodestone.sources import scan, store

from .conftest import rows


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(expression).first()[0]


@pytest.mark.parametrize(
    "path, language, role, ecosystem",
    [
        ("src/a.ts", "typescript", "source", None), ("tests/a.py", "python", "test", None), ("a/x.test.js", "javascript", "test", None), ("Dockerfile", "dockerfile", "infrastructure", None),
        ("docs/Dockerfile", "dockerfile", "infrastructure", None), ("docs/a.json", "json", "documentation", None), ("a.json", "json", "configuration", None), ("package.json", "json", "manifest", "npm"),
        ("a/b.csproj", None, "manifest", "nuget"), ("yarn.lock", None, "build", None), ("LICENSE", None, "other", None), ("infra/a.py", "python", "infrastructure", None), ("a.toml", "toml", "configuration", None),
    ],
)
def test_paths(spark, path, language, role, ecosystem):
    p = F.lit(path)
    r = spark.range(1).select(paths.language_of(p), paths.role_of(p, paths.language_of(p)), paths.ecosystem_of(p)).first()
    assert tuple(r) == (language, role, ecosystem)


def test_region_role(spark):
    for path, role in (("AzureSamples/a.ts", "sample"), ("ai100-samples/x.py", "sample"), ("AzureDeployment/a.py", "deployment"), ("src/samples/a.java", "production"), ("docs_src/a.py", "documentation"), (".config/a", "production"), ("config/a", "configuration"), ("x/.next/a.js", "generated"), ("wiki/a.md", "documentation"), ("src/a.ts", "production"), ("vendor/x/a.js", "vendored"), ("benchmarks/tests/a.py", "benchmark"), ("a/dist/x.js", "generated"), (".github/workflows/a.yml", "ci")):
        assert spark.range(1).select(paths.region_role(F.lit(path))).first()[0] == role, path


def test_instants(spark):
    same = ["2031-01-01T10:00:00Z", "2031-01-01T10:00:00.000Z", "2031-01-01 10:00:00", "2031-01-01T12:00:00+02:00", "2031-01-01T05:00:00-05:00"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in same], "s string").select(instant_us(F.col("s"))).collect()]
    assert len(set(got)) == 1 and got[0] == 1925028000000000
    assert spark.createDataFrame([("never",), (None,), ("",)], "s string").select(instant_us(F.col("s"))).distinct().collect() == [(None,)]


def test_regions(spark):
    files = spark.createDataFrame([(1, "a/b/x.py"), (1, "a/y.py"), (1, "ab/z.py"), (1, "w.py"), (2, "a/v.py")], "repo_id bigint, path string")
    anchors = spark.createDataFrame([(1, "a"), (1, "a/b")], "repo_id bigint, region string")
    assert rows(regions.regions(files, anchors)) == [(1, "a/b/x.py", "a/b"), (1, "a/y.py", "a"), (1, "ab/z.py", "."), (1, "w.py", "."), (2, "a/v.py", ".")]


def test_technologies(spark):
    files = spark.createDataFrame(
        [
            (1, "web/package.json", '{"name": "web", "dependencies": {"react": "1", "next": "2"}, "devDependencies": {"vitest": "1"}}'),
            (1, "api/requirements.txt", "flask==1\n# comment\nSQLAlchemy>=2\n"),
            (1, "api/poetry.lock", ""),
            (1, "k/a.yaml", "apiVersion: v1\nkind: Pod\n"),
            (1, "k/b.yaml", "kind: Pod\n"),
            (1, "Dockerfile", "FROM x"),
        ],
        "repo_id bigint, path string, contents string",
    )
    placed = files.select("repo_id", "path", F.split("path", "/")[0].alias("region"))
    got = {(r.region, r.id): (r.category, r.confidence) for r in technology.detect(files, placed).collect()}
    assert got == {
        ("web", "react"): ("frontend", "CERTAIN"), ("web", "nextjs"): ("frontend", "CERTAIN"), ("web", "vitest"): ("testing", "CERTAIN"), ("api", "flask"): ("backend", "CERTAIN"),
        ("api", "sqlalchemy"): ("data", "CERTAIN"), ("api", "poetry"): ("build", "CERTAIN"), ("k", "kubernetes"): ("infrastructure", "INFERRED"), ("Dockerfile", "docker"): ("infrastructure", "CERTAIN"),
    }
    go = one(spark, technology.declared_dependencies(F.col("c"), F.lit("go.mod")), c="module a\nrequire (\n\tgithub.com/b/c v1\n\tx.io/y v2 // indirect\n)\n")
    assert go == ["github.com/b/c", "x.io/y"]
    assert one(spark, technology.declared_name(F.col("c"), F.lit("go.mod")), c="module a.b/c\n") == "a.b/c"
    assert one(spark, technology.declared_dependencies(F.col("c"), F.lit("gemfile")), c="gem 'rails'\ngem \"pg\"\n") == ["pg", "rails"]
    assert one(spark, technology.declared_dependencies(F.col("c"), F.lit("package.json")), c="not json") == []


YAML = "on:\n  push:\njobs:\n  build:\n    needs: test\n    env:\n      TOKEN: ${{ secrets.KEY }}\n    steps:\n      - name: go\n        run: |\n          bash x.sh\n      - uses: act/x@v1\n"
ARTEFACTS = [
    ("ci.yml", YAML, "ci-workflow", {("trigger", "push"), ("job", "build"), ("condition", "needs: test"), ("variable", "TOKEN"), ("step", "go"), ("step", "act/x@v1"), ("command", "|")}),
    ("compose.yml", "services:\n  db:\n    image: pg:1\n    ports:\n      - '1:2'\n    environment:\n      A: b\n", "container-compose", {("service", "db"), ("image", "pg:1"), ("port", "1:2"), ("variable", "A")}),
    ("p.yaml", "apiVersion: v1\nkind: Pod\nmetadata:\n  name: x\n", "orchestration-resource", {("resource", "Pod x")}),
    ("Dockerfile", "FROM a AS b\nRUN c \\\n  d\nEXPOSE 80\nENV K=v\n", "container-image", {("stage", "b"), ("image", "a"), ("command", "c    d"), ("port", "80"), ("variable", "K")}),
    ("package.json", '{"name": "n", "scripts": {"t": "vitest"}, "workspaces": ["p/*"]}', "package-manifest", {("setting", "name"), ("script-target", "t"), ("member", "p/*")}),
    ("a.sql", "CREATE TABLE IF NOT EXISTS t (\n id int);\ncreate unique index i on t(id);\n", "schema", {("entity", "t"), ("index", "i")}),
    ("a.md", "Title\n=====\n\n```\n# no\n```\n## Part\n### Sub\n", "documentation", {("heading", "Title"), ("heading", "Part"), ("heading", "Sub")}),
    ("a.sh", "#!/bin/sh\nf() {\nKEY=1\nls x\n", "script", {("setting", "interpreter"), ("script-target", "f"), ("variable", "KEY"), ("command", "ls x")}),
    (".env", "A=secret\nexport B=c\n", "environment-configuration", {("variable", "A"), ("variable", "B")}),
    ("m.tf", 'resource "a" "b" {}\nvariable "c" {}\n', "infrastructure-as-code", {("resource", "a.b"), ("input", "c")}),
    ("a.json", '{"k": 1, "o": {"x": 2}}', "data", {("setting", "k"), ("section", "o")}),
    ("tests/a.py", "class TestA:\n  def test_b(self): pass\n", "test", {("section", "TestA"), ("step", "test_b")}),
    ("yarn.lock", "x", "lockfile", set()),
    ("a.bin", "x", "unknown-artifact", set()),
]


def test_artefacts(spark):
    files = spark.createDataFrame([(1, p, c) for p, c, _, _ in ARTEFACTS] + [(1, "null.md", None), (1, "empty.md", "")], "repo_id bigint, path string, contents string")
    families = {r.path: r.family for r in artifacts.families(files).collect()}
    got: dict = {}
    for r in artifacts.elements(files).collect():
        got.setdefault(r.path, set()).add((r.kind, r.name))
    for path, _, family, wanted in ARTEFACTS:
        assert families[path] == family, path
        assert got.get(path, set()) == wanted, path
    assert "null.md" not in got and "empty.md" not in got


def test_artefact_cap_is_counted(spark):
    text = "".join(f"# h{i}\n" for i in range(100))
    got = artifacts.elements(spark.createDataFrame([(1, "a.md", text)], "repo_id bigint, path string, contents string")).collect()
    assert len(got) == 60 and {r.dropped for r in got} == {40}


def test_paths_in_texts(spark):
    c = lambda t, at="a/b.yml": one(spark, artifacts.path_candidates(F.col("t"), F.lit(at)), t=t)
    assert c("./x.sh") == ["a/x.sh"] and c("../y/x.sh") == ["y/x.sh"] and c("../../x.sh") == []
    assert c("x/y.sh") == ["x/y.sh", "a/x/y.sh"] and c("make") == [] and c("http://a/b.sh") == [] and c("x y.sh") == [] and c("z.py#1") == ["z.py", "a/z.py"]
    assert one(spark, artifacts.environment_names(F.col("t")), t="${{ secrets.A }} ${B} ${D:-x} ${E $F $low ${low} $LONG ${{ vars.lower }}") == ["A", "B", "D", "LONG"]
    assert one(spark, artifacts.invoked_paths(F.col("t"), F.lit("ci.yml")), t="cd x.sh && bash ./run.sh -e a; node b/c.js | ./tee.sh d.txt\nnpm run build.js") == ["./run.sh", "b/c.js", "./tee.sh", "d.txt"]


def test_tool_configuration(spark):
    names = ["tsconfig.json", ".eslintrc", ".eslintrc.json", "a/jest.config.js", "x.conf.yaml", "package.json", ".env.local", "env.example", "k.yaml", "src/a.ts"]
    files = spark.createDataFrame([(1, n, "a: 1\n") for n in names] + [(1, None, "x")], "repo_id bigint, path string, contents string")
    got = {r.path: r.family for r in artifacts.families(files).collect()}
    tool, env = "tool-configuration", "environment-configuration"
    assert [got[n] for n in names] == [tool, tool, tool, tool, tool, "package-manifest", env, env, "data", "unknown-artifact"] and got[None] == "unknown-artifact"
    assert artifacts.families(files.limit(0)).collect() == []
    found = spark.createDataFrame([(1, "a/b.yml", "./x.sh"), (1, "a/b.yml", "q/z.py"), (1, "a/b.yml", "make")], "repo_id bigint, path string, text string")
    files = spark.createDataFrame([(1, "a/x.sh"), (1, "a/q/z.py")], "repo_id bigint, path string")
    assert rows(artifacts.resolved_references(found, files).select("text", "target")) == [("./x.sh", "a/x.sh"), ("make", None), ("q/z.py", "a/q/z.py")]


def test_identities(spark):
    assert one(spark, construct.route_id(F.lit("get"), F.lit("//a//b/"))) == "route:GET:/a/b"
    assert one(spark, construct.route_id(F.lit("get"), F.lit("a"))) is None
    assert one(spark, construct.declaration_id(F.lit("p"), F.array(F.lit("A"), F.lit("b")))) == "sym:p#A.b"
    assert one(spark, construct.declaration_id(F.lit("p"), F.array(F.lit("A.b")))) is None
    assert one(spark, construct.env_id(F.lit(" A1 "))) == "env:A1" and one(spark, construct.env_id(F.lit("1A"))) is None
    assert one(spark, construct.external_id(F.lit("npm"), F.lit("x"))) == "ext:npm:x" and one(spark, construct.external_id(F.lit("outside-analysis"), F.lit(None))) == "ext:outside-analysis"
    n = F.lit(None)
    assert one(spark, construct.edge_id(F.lit("CALLS"), F.lit("a"), F.lit("b"), n, n, F.lit(1), F.lit(2))) == "edge:CALLS|a|b|||1:2"


NODES = "repo_id bigint, id string, kind string, name string, file_id string, container_chain string"
EDGES = "repo_id bigint, id string, type string, source_id string, target_id string, confidence string, ordinal int, provenance_file string"


def small(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_route_links_and_merge(spark):
    g = small(spark, [(1, "route:GET:/users/:id", "Route", "GET /users/:id", None, None), (1, "route:ALL:/x", "Route", "ALL /x", None, None)], [])
    calls = spark.createDataFrame([(1, "a", "get", "/users/42/?q=1"), (1, "b", "post", "/users/7"), (1, "c", None, "/users/{x}"), (1, "d", "PUT", "/x/"), (1, "e", None, "http://h/x")], "repo_id bigint, caller_id string, method string, url string")
    assert rows(construct.link_client_calls(calls, g)) == [(1, "a", "route:GET:/users/:id"), (1, "c", "route:GET:/users/:id"), (1, "d", "route:ALL:/x")]
    seen = spark.createDataFrame([(1, "get", "/a", "f", 3, "INFERRED"), (1, "GET", "/a/", "g", 1, "RESOLVED"), (1, "get", "b", "f", 1, "CERTAIN")], "repo_id bigint, method string, path string, file_id string, line int, confidence string")
    assert rows(construct.merged_routes(seen)) == [(1, "route:GET:/a", "RESOLVED", 2, None, [1, 3])]


def test_validation(spark):
    nodes = [(1, "file:a", "File", "a", None, None), (1, "sym:a#A", "Class", "A", "file:a", "A"), (1, "sym:b#B", "Class", "B", "file:b", "B")]
    edges = [(1, "e1", "IMPORTS", "file:a", "sym:a#A", "CERTAIN", None, "file:a"), (1, "e2", "IMPORTS", "sym:a#A", "file:a", "CERTAIN", None, None), (1, "e3", "CALLS", "file:a", "gone", "CERTAIN", None, "file:c")]
    g = small(spark, nodes, edges)
    assert rows(construct.violations(g).select("rule", "id")) == [("ends-not-allowed", "e2"), ("file-missing", "sym:b#B"), ("provenance-file-missing", "e3"), ("target-missing", "e3")]
    with pytest.raises(construct.InvalidGraph):
        construct.validate(g)
    construct.validate(small(spark, nodes[:2], edges[:1]))


def test_dedupe_and_pooling(spark):
    df = spark.createDataFrame([(1, "m2", 2, "npm", "x"), (1, "m1", 1, "npm", "x"), (1, "m1", 1, "npm", "y")], "repo_id bigint, manifest string, seq int, ecosystem string, name string")
    assert rows(construct.pooled_dependencies(df).select("name", "manifest", "manifests", "id")) == [("x", "m1", 2, "dep:npm:x"), ("y", "m1", 1, "dep:npm:y")]
    assert rows(construct.first_of(df, ["repo_id", "name"], ["seq", "manifest"]).select("name", "manifest")) == [("x", "m1"), ("y", "m1")]


DECL = "repo_id bigint, id string, file_id string, kind string, name string, chain array<string>"


def test_binding(spark):
    f = "file:s"
    declarations = spark.createDataFrame(
        [
            (1, "sym:s#Base", f, "Class", "Base", ["Base"]), (1, "sym:s#Base.save", f, "Method", "save", ["Base", "save"]), (1, "sym:s#Store", f, "Class", "Store", ["Store"]),
            (1, "sym:s#Store.constructor", f, "Constructor", "constructor", ["Store", "constructor"]), (1, "sym:s#Store.get", f, "Method", "get", ["Store", "get"]),
            (1, "sym:s#helper", f, "Function", "helper", ["helper"]), (1, "sym:s#run.helper", f, "Function", "helper", ["run", "helper"]), (1, "sym:s#run", f, "Function", "run", ["run"]),
        ],
        DECL,
    )
    imports = spark.createDataFrame([(1, f, "lib", "ext:npm:old", 1), (1, f, "lib", "ext:npm:lib", 2), (1, "file:t", "Store", "sym:s#Store", 1)], "repo_id bigint, file_id string, local_name string, target_id string, seq int")
    extends = spark.createDataFrame([(1, "sym:s#Store", "sym:s#Base")], "repo_id bigint, child_id string, parent_id string")
    sites = [
        ("1", f, ["run"], "helper", None, False, "call", "sym:s#run.helper", "scope"), ("2", f, [], "helper", None, False, "call", "sym:s#helper", "scope"),
        ("3", f, ["Store", "get"], "this", "save", False, "call", "sym:s#Base.save", "member"), ("4", "file:t", [], "Store", None, True, "call", "sym:s#Store.constructor", "import"),
        ("5", f, [], "lib", "go", False, "external", "ext:npm:lib", "external-root"), ("6", f, [], "nothing", None, False, "unresolved", None, "name-not-bound"),
        ("7", "file:t", [], "Store", "save", False, "call", "sym:s#Base.save", "imported-member"), ("8", f, [], "x", "y", False, "unresolved", None, "root-not-bound"), ("9", f, [], "lib", None, False, "external", "ext:npm:lib", "import"),
    ]
    calls = spark.createDataFrame([(1, *s[:6]) for s in sites], "repo_id bigint, site_id string, file_id string, scope array<string>, root string, member string, is_construction boolean")
    got = rows(binding.bind_calls(calls, declarations, imports, extends).select("site_id", "outcome", "target_id", "rule"))
    assert got == [(s[0], *s[6:]) for s in sites]
    assert rows(binding.bind_calls(calls.limit(0), declarations, imports, extends)) == []


def test_merge_ambiguity_and_externals(spark):
    parts = spark.createDataFrame([(1, "d", "Variable", None, False, 5, 1), (1, "d", "Namespace", "public", True, 2, 2)], "repo_id bigint, id string, kind string, visibility string, is_exported boolean, line int, seq int")
    assert rows(binding.merged_declarations(parts)) == [(1, "d", "Namespace", "public", True, [2, 5])]
    df = spark.createDataFrame([(1, "e", ["b", "a"]), (1, "f", ["c"])], "repo_id bigint, id string, targets array<string>")
    assert rows(binding.ambiguous(df).select("id", "target_id", "confidence", "candidate_group")) == [("e", "a", "AMBIGUOUS", "e|a,b"), ("e", "b", "AMBIGUOUS", "e|a,b"), ("f", "c", "RESOLVED", None)]
    for text, want in (("node:fs", ("stdlib", "fs", "CERTAIN")), ("@a/b/c", ("npm", "@a/b", "INFERRED")), ("x/y", ("npm", "x", "INFERRED")), ("./z", None)):
        got = one(spark, binding.external_of(F.col("t")), t=text)
        assert (tuple(got) if got else None) == want


def test_framework(spark):
    arg = "array<struct<text:string,value:string>>"
    sites = spark.createDataFrame(
        [
            (1, "file:a", None, "app", "get", [("'/u'", "/u"), ("auth", None), ("list", None)], 1), (1, "file:a", None, "app", "get", [("'/only'", "/only")], 2), (1, "file:a", None, "app", "use", [("auth", None), ("'x'", "x")], 3),
            (1, "file:a", "sym:a#f", "fetch", None, [("'/u'", "/u"), ("{ method: 'DELETE' }", None)], 4), (1, "file:a", None, "api", "post", [("'http://h'", "http://h")], 5), (1, "file:a", None, "cache", "read", [("'/t'", "/t")], 6),
        ],
        f"repo_id bigint, file_id string, scope_id string, root string, member string, args {arg}, line int",
    )
    decl = spark.createDataFrame([(1, "sym:a#auth", "file:a", "Function", "auth", ["auth"])], DECL)
    got = rows(framework.express_routes(sites, decl).select("route_id", "ordinal", "handler", "handler_id", "position"))
    assert got == [("route:GET:/u", 0, "auth", "sym:a#auth", "middleware"), ("route:GET:/u", 1, "list", None, "handler")]
    assert rows(framework.mounted_middleware(sites, decl).select("handler_id")) == [("sym:a#auth",)]
    assert rows(framework.client_calls(sites.where("line > 3")).select("caller_id", "method", "url")) == [("file:a", "POST", "http://h"), ("sym:a#f", "DELETE", "/u")]
    access = spark.createDataFrame([(1, "file:a", None, "process", ["env", "KEY"], 1), (1, "file:a", "s", "process", ["env"], 2)], "repo_id bigint, file_id string, scope_id string, root string, path array<string>, line int")
    assert rows(framework.environment_reads(access).select("reader_id", "env_id")) == [("file:a", "env:KEY")]


def test_grounding_and_claims(spark):
    answers = spark.createDataFrame(
        [
            (1, "It calls sym:a#b. [f1, f3-f4]"), (2, "See sym:x#gone; and [f9]."), (3, "Nothing to cite here."), (4, None), (5, "[f1-f900]"),
        ],
        "answer_id bigint, text string",
    )
    known = spark.createDataFrame([(a, f"f{i}", "sym:a#b at depth 2", "x") for a in (1, 2, 5) for i in (1, 3, 4, 900)], "answer_id bigint, fact_id string, subject string, object string")
    got = {r.answer_id: r for r in retrieval.grounding(answers, known).collect()}
    assert got[1].verdict == "grounded" and got[1].citations == ["f1", "f3", "f4"]
    assert got[2].verdict == "ungrounded" and got[2].unknown_citations == ["f9"] and got[2].fabricated == ["sym:x#gone"]
    assert got[3].verdict == got[4].verdict == "unverifiable" and got[5].citations == ["f1", "f900"]
    texts = spark.createDataFrame([(1, "There are no tests in here. It was not detected that there are no routes. You should begin with the api. It might lack nothing."), (2, "You should begin with the api.")], "answer_id bigint, text string")
    predicates = spark.createDataFrame([(2, "onboarding")], "answer_id bigint, predicate string")
    found = retrieval.claims(texts, predicates)
    assert rows(found.select("answer_id", "kind", "strength")) == [(1, "absence-as-nonexistence", "unsupported"), (1, "recommendation-without-evidence", "unsupported")]
    left = rows(retrieval.finalised(texts, found, "none"))
    assert left == [(1, "It was not detected that there are no routes. It might lack nothing."), (2, "You should begin with the api.")]


def test_projection(spark):
    facts = spark.createDataFrame([("p", f"s{i % 4}", "calls", "o" * (i % 4 + 1), i) for i in range(8)], "part string, subject string, predicate string, object string, seq int").withColumn("g", F.lit(1))
    kept = retrieval.projected(facts, 8, group=["g"], order=["seq"])
    assert rows(kept.select("fact_id", "seq", "cost", "upto")) == [("f1", 0, 3, 3), ("f2", 1, 4, 7)]
    assert rows(retrieval.omissions(facts, kept, ["g"])) == [(1, "p", 4, 2)]
    assert rows(retrieval.projected(facts, 8, group=["g"], order=["seq"], share=0.5).select("seq")) == [(0,)]
    assert [one(spark, retrieval.tokens(F.lit(t))) for t in ("", "a", "a" * 36, "a" * 37)] == [0, 1, 10, 11]
    assert [one(spark, retrieval.tier(F.lit(w))) for w in (100, 3000, 6800, 48000)] == ["minimal", "minimal", "standard", "full"]
    import hashlib

    assert one(spark, retrieval.digest(F.array(F.lit("a"), F.lit("b")))) == hashlib.sha256(b"a\0b\0").hexdigest()[:16]


def test_names_and_conversations(spark):
    for name, want in (("@a/b", "@a"), ("org.x:y", "org.x"), ("github.com/a/b", "github.com/a"), ("java.util.List", "java.util"), ("left", "left")):
        assert one(spark, retrieval.name_family(F.col("n")), n=name) == want
    for name, want in (("createUserController", "user"), ("order_item_service", "order item"), ("ServiceFactory", None)):
        assert one(spark, retrieval.domain_noun(F.col("n")), n=name) == want
    turns = spark.createDataFrame([(1, i, f"q{i}", "t" if i % 2 else f"t{i}", "g" if i < 2 else None) for i in range(6)], "conv_id bigint, position int, question string, topic string, goal string")
    r = retrieval.conversation_state(turns).first()
    assert (r.recent, r.covered, r.goals) == (["q2", "q3", "q4", "q5"], ["t0", "t", "t2", "t4"], ["g"])
    questions = spark.createDataFrame([(1, "What breaks if I change this?"), (2, "How is it built"), (3, "Hi")], "question_id bigint, text string")
    keys = spark.createDataFrame([("impact", 1, "what breaks"), ("build", 2, "built"), ("other", 3, "change")], "intent string, rank int, keyword string")
    assert rows(retrieval.intents(questions, keys)) == [(1, "impact"), (2, "build"), (3, None)]


def test_quality(spark):
    edges = spark.createDataFrame([(1, "CALLS")] * 3, "repo_id bigint, type string")
    lost = spark.createDataFrame([(1, "CALLS", "x"), (1, "READS", "y")], "repo_id bigint, type string, reason string")
    assert rows(quality.bind_rates(edges, lost)) == [(1, "CALLS", 3, 1, 0.75), (1, "READS", 0, 1, 0.0)]
    a = spark.createDataFrame([(1, "CALLS", 0.5)], "repo_id bigint, type string, rate double")
    b = spark.createDataFrame([(1, "CALLS", 0.75), (1, "READS", 1.0)], "repo_id bigint, type string, rate double")
    assert rows(quality.compare(a, b)) == [(1, "CALLS", 0.5, 0.75, 25.0), (1, "READS", None, 1.0, None)]
    expected = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "g string, k string")
    produced = spark.createDataFrame([("c", "x"), ("c", "w"), ("c", "x"), ("n", "q")], "g string, k string")
    assert rows(quality.precision_recall(expected, produced, ["g"], ["k"])) == [("c", 2, 2, 1, 0.5, 0.5), ("d", 1, 0, 0, None, 0.0)]


def test_store_and_scan(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/node_modules/b.js").write_text("x")
    (tmp_path / "package.json").write_text("{}")
    files = scan.scan(spark, str(tmp_path))
    assert rows(files.select("path", "language", "role", "ecosystem", "bytes", "contents")) == [("package.json", "json", "manifest", "npm", 2, "{}"), ("src/a.py", "python", "source", None, 6, "x = 1\n")]
    assert rows(scan.directories(files)) == [(1, "."), (1, "src")]
    first = store.fingerprint(files).first()["source_hash"]
    assert store.fingerprint(files.repartition(3)).first()["source_hash"] == first
    g = small(spark, [(1, "file:a", "File", "a", None, None)], [(1, "e", "CALLS", "file:a", "x", "CERTAIN", None, None)])
    path = f"file://{tmp_path}/graph"
    assert store.write_if_changed(g, path, first) and not store.write_if_changed(g, path, first) and store.write_if_changed(g, path, "other")
    assert store.read_graph(spark, path).nodes.count() == 1
    spark.createDataFrame([(3, "x")], "schema_version int, source_hash string").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(store.WrongVersion):
        store.read_graph(spark, path)


def test_stream(spark, tmp_path):
    from datetime import datetime

    from lodestone.streaming.counters import coupling_counts

    schema = "repo_id bigint, id string, target_id string, arrived timestamp"
    data = [(1, "e1", " a ", datetime(2031, 1, 1)), (1, "e1", "a", datetime(2031, 1, 1)), (1, "e2", "a", datetime(2031, 1, 1))]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/in")
    counted = coupling_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = counted.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("counts")) == [(1, "a", 2)]
