from lodestone.operators import browse
from lodestone.plans.graph import Graph

from .conftest import rows

NODES = "repo_id bigint, id string, kind string, name string, file_id string, is_exported boolean"
EDGES = "repo_id bigint, id string, type string, source_id string, target_id string, confidence string"


def graph(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_lists_are_cut_and_counted(spark):
    df = spark.createDataFrame([(1, "hub", f"e{i:03}") for i in range(250)] * 2 + [(1, "b", "x"), (1, "b", None), (2, "hub", "y")], "repo_id bigint, id string, entry string")
    got = {(r.repo_id, r.id): r for r in browse.listed(df, ["repo_id", "id"], "xs").collect()}
    assert got[1, "hub"].n_xs == 250 and got[1, "hub"].xs == [f"e{i:03}" for i in range(100)]
    assert (got[1, "b"].n_xs, got[1, "b"].xs, got[2, "hub"].xs) == (1, ["x"], ["y"])
    assert rows(browse.listed(df.limit(0), ["repo_id", "id"], "xs")) == []


def test_symbols_files_and_packages(spark):
    nodes = [(1, f"file:{f}", "File", f, None, None) for f in ("p/a/x.py", "p/b/y.py")]
    nodes += [(1, "C", "Class", "C", "file:p/a/x.py", True), (1, "m", "Method", None, "file:p/a/x.py", None), (1, "f", "Function", "f", "file:p/b/y.py", False), (1, "lost", "Function", "l", None, True)]
    edges = [
        (1, "1", "DECLARES", "C", "m", "CERTAIN"), (1, "2", "CALLS", "f", "m", "RESOLVED"), (1, "3", "CALLS", "f", "m", None), (1, "4", "IMPORTS", "file:p/b/y.py", "C", "CERTAIN"),
        (1, "5", "READS", "m", "env:A", "CERTAIN"), (1, "6", "CONTAINS", "C", "m", "CERTAIN"),
    ]
    g = graph(spark, nodes, edges)
    got = {r.id: r for r in browse.symbols(g).collect()}
    assert got["m"].parent_id == "C" and got["m"].callers == ["f"] and got["m"].referrers == ["f"] and got["m"].variables == ["env:A"]
    assert got["C"].members == ["m"] and got["C"].referrers == ["file:p/b/y.py"] and got["lost"].parent_id is None and got["lost"].callers == []
    files = {r.id: r for r in browse.files(g).collect()}
    assert files["file:p/a/x.py"].declarations == ["C", "m"] and files["file:p/a/x.py"].importers == ["file:p/b/y.py"] and files["file:p/b/y.py"].imports == ["C"]
    packages = {r.package: r for r in browse.packages(g).collect()}
    assert packages["p/b"].needs == ["p/a"] and packages["p/a"].needed_by == ["p/b"] and packages["p/a"].exported == ["C"]
    (o,) = browse.overview(g).collect()
    assert (o.nodes, o.files, o.declarations, o.edges, o.certain, o.resolved) == (6, 2, 4, 6, 4, 1)
    empty = graph(spark, [], [])
    for operator in (browse.symbols, browse.files, browse.packages, browse.overview, browse.neighbours):
        assert operator(empty).collect() == []
