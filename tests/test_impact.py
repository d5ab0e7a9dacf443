import random

from lodestone.operators.impact import dependents, statistics
from lodestone.plans.graph import Graph

from .conftest import rows


def graph(spark, seed):
    rng = random.Random(seed)
    nodes = [(r, f"n{i}", rng.choice(["Method", "Class", "File", "Route", "External"])) for r in (1, 2) for i in range(14)]
    edges = [(r, f"e{r}{i:03}", rng.choice(["CALLS", "IMPORTS", "DECLARES"]), f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for r in (1, 2) for i in range(40)]
    return Graph(spark.createDataFrame(nodes, "repo_id bigint, id string, kind string"), spark.createDataFrame(edges, "repo_id bigint, id string, type string, source_id string, target_id string"))


def test_one_task_or_all_give_the_same(spark):
    for seed in (1, 2):
        g = graph(spark, seed)
        targets = spark.createDataFrame([(1, "n0"), (1, "n1"), (2, "n2"), (2, "gone"), (1, "n0")], "repo_id bigint, id string")
        near, far = rows(dependents(g, targets)), rows(dependents(g, targets, local=0))
        assert near == far and near
        assert rows(dependents(g, targets, most=1)) == [r for r in near if r[4] == 1]


def test_discovery_order_and_kinds(spark):
    nodes = [(1, x, k) for x, k in (("t", "Method"), ("a", "Method"), ("b", "Class"), ("c", "Method"), ("r", "Route"), ("x", "ArtifactElement"), ("y", "Method"))]
    edges = [(1, "e2", "CALLS", "a", "t"), (1, "e1", "CALLS", "b", "t"), (1, "e9", "CALLS", "c", "b"), (1, "e0", "CALLS", "c", "a"), (1, "e5", "HANDLED_BY", "r", "t"), (1, "e6", "REFERENCES", "x", "t"), (1, "e7", "CALLS", "y", "x"), (1, "e8", "DECLARES", "y", "t"), (1, "e4", "CALLS", "t", "c")]
    g = Graph(spark.createDataFrame(nodes, "repo_id bigint, id string, kind string"), spark.createDataFrame(edges, "repo_id bigint, id string, type string, source_id string, target_id string"))
    targets = spark.createDataFrame([(1, "t")], "repo_id bigint, id string")
    got = dependents(g, targets)
    # b was found before a, so c is found by the edge to b although the edge to a has the lesser id
    assert rows(got.select("id", "depth", "via", "reach")) == [("a", 1, "e2", "DIRECT"), ("b", 1, "e1", "DIRECT"), ("c", 2, "e9", "INDIRECT"), ("x", 1, "e6", "DIRECT")]
    assert rows(statistics(got, targets)) == [(1, "t", 4, 3, 2)]
    assert rows(dependents(g, targets.limit(0))) == []
