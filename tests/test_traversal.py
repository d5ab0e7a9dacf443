import random

import pytest

from lodestone.operators.traversal import components, cycles, levels, reach

from .conftest import rows

EDGES = "repo_id bigint, source_id string, target_id string"


def graph(spark, text, repo=1):
    pairs = [tuple(e.split(">")) for e in text.split()]
    return spark.createDataFrame([(repo, a, b) for a, b in pairs], EDGES)


def brute_reach(pairs, start):
    seen, frontier, depth = {start: 0}, [start], 0
    while frontier:
        depth += 1
        frontier = sorted({b for a, b in pairs if a in frontier} - set(seen))
        seen |= {x: depth for x in frontier}
    return seen


CASES = {
    "chain": ("a>b b>c", set()),
    "two": ("a>b b>a", {("a", "a"), ("b", "a")}),
    "loop": ("a>a", {("a", "a")}),
    "two cycles": ("a>b b>a c>d d>c", {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}),
    "joined one way": ("a>b b>a b>c c>d d>c", {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}),
}


@pytest.mark.parametrize("local", [0, 1000])
@pytest.mark.parametrize("name", sorted(CASES))
def test_cycles(spark, name, local):
    text, want = CASES[name]
    assert {(r.id, r.cycle) for r in cycles(graph(spark, text), local).collect()} == want


@pytest.mark.parametrize("local", [0, 1000])
def test_random_graphs(spark, local):
    rng = random.Random(3)
    data, want_cycles, want_parts = [], set(), set()
    for repo in range(1, 5):
        names = [f"n{i}" for i in range(14)]
        pairs = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(5, 24))}
        data += [(repo, a, b) for a, b in pairs] * 2
        hit = {x: brute_reach(pairs, x) for x in names}
        back = {x: {y for y in names if x in hit[y] and y in hit[x]} for x in names}
        want_cycles |= {(repo, x, min(back[x])) for x in names if len(back[x]) > 1 or (x, x) in pairs}
        both = pairs | {(b, a) for a, b in pairs}
        want_parts |= {(repo, x, min(brute_reach(both, x))) for x in names if any(x in p for p in pairs)}
    rng.shuffle(data)
    df = spark.createDataFrame(data, EDGES)
    assert {tuple(r) for r in cycles(df, local).select("repo_id", "id", "cycle").collect()} == want_cycles
    assert {tuple(r) for r in components(df, local).select("repo_id", "id", "component").collect()} == want_parts


@pytest.mark.parametrize("local", [0, 1000])
def test_empty_and_nulls(spark, local):
    empty = spark.createDataFrame([], EDGES)
    assert rows(cycles(empty, local)) == [] and rows(components(empty, local)) == []
    odd = spark.createDataFrame([(1, None, "a"), (1, "a", None), (None, "a", "a")], EDGES)
    assert rows(cycles(odd, local)) == [] and rows(components(odd, local)) == []


def test_long_chain_and_cycle(spark):
    n = 3000
    chain = spark.createDataFrame([(1, f"{i:05}", f"{(i + 1) % n:05}") for i in range(n)], EDGES)
    assert {r.cycle for r in cycles(chain).collect()} == {"00000"}
    short = chain.where("source_id < '00040'")
    assert {r.component for r in components(short, 0).collect()} == {"00000"}


@pytest.mark.parametrize("local", [0, 1000])
def test_reach(spark, local):
    df = graph(spark, "r>a a>b b>a b>c x>c")
    roots = spark.createDataFrame([(1, "r"), (1, "r"), (1, "x")], "repo_id bigint, id string")
    got = {r.id: r.depth for r in reach(df, roots, local=local).collect()}
    assert got == {"r": 0, "x": 0, "a": 1, "c": 1, "b": 2}
    assert rows(reach(df, roots.limit(0), local=local)) == []
    apart = spark.createDataFrame([(1, "r", "g"), (1, "x", "h")], "repo_id bigint, id string, of string")
    assert {(r.of, r.id) for r in reach(df, apart, group=["of"]).collect()} == {("g", x) for x in "rabc"} | {("h", "x"), ("h", "c")}
    assert {r.id for r in reach(df, roots, most=1, local=local).collect()} == {"r", "x", "a", "c"}


def test_levels(spark):
    df = graph(spark, "app>lib lib>core app>core p>q q>p r>p loop>loop app>outside")
    nodes = spark.createDataFrame([(1, x) for x in "app lib core p q r loop".split()], "repo_id bigint, id string")
    got = {r.id: r.level for r in levels(nodes, df).collect()}
    assert got == {"core": 0, "lib": 1, "app": 2, "loop": 0, "p": None, "q": None, "r": None}
