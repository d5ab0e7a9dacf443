import random

import pytest

from lodestone.llm.mixing import mix, plan, running_sum

from ..conftest import rows

DOCS = "doc_id bigint, source string, text string, copy int"
TARGETS = "source string, target_weight double, max_repeats int"


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(1)
    data = []
    for i in range(900):
        s = rng.choices(["big", "mid", "small", None, "other"], [60, 25, 5, 5, 5])[0]
        data.append((i, f" {s.upper()} " if s and i % 7 == 0 else s, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 60))), 0))
    return spark.createDataFrame(data + [(1000, "big", None, 0), (1001, "big", "", 0)], DOCS)


TARGET_ROWS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 6), ("absent", 0.05, 9)]


def test_shares_and_repeats(spark, documents):
    got = mix(documents, spark.createDataFrame(TARGET_ROWS, TARGETS))
    report = {r.source: r for r in got.shares.collect()}
    assert set(report) == {"big", "mid", "small", "absent"}
    assert report["absent"].tokens_drawn == 0
    for s, w, m in TARGET_ROWS[:3]:
        assert abs(report[s].share - w / 0.95) < 0.02
        assert report[s].repeats <= m
    drawn = got.drawn.collect()
    assert {r.source for r in drawn} == {"big", "mid", "small"}
    assert len({(r.doc_id, r.copy) for r in drawn}) == len(drawn)
    # a copy is drawn only after the one before it
    seen = {(r.doc_id, r.copy) for r in drawn}
    assert all(c == 1 or (d, c - 1) in seen for d, c in seen)
    # in training order over the partitions
    positions = [r.position for r in drawn]
    assert positions == sorted(positions)


def test_the_schedule_leans(spark, documents):
    got = mix(documents, spark.createDataFrame(TARGET_ROWS, TARGETS), lean=1.0)
    end = max(r.position for r in got.drawn.collect())
    half = [r for r in got.drawn.collect() if r.position < end / 2]
    late = [r for r in got.drawn.collect() if r.position >= end / 2]
    share = lambda rs, s: sum(r.tokens for r in rs if r.source == s) / sum(r.tokens for r in rs)
    assert share(late, "small") > share(half, "small") and share(late, "big") < share(half, "big")


def test_larger_total_is_capped(spark, documents):
    got = {r.source: r for r in mix(documents, spark.createDataFrame(TARGET_ROWS, TARGETS), total=10**9).shares.collect()}
    assert got["mid"].tokens_drawn == 2 * got["mid"].tokens and got["small"].tokens_drawn == 6 * got["small"].tokens


def test_empty(spark, documents):
    targets = spark.createDataFrame(TARGET_ROWS, TARGETS)
    empty = mix(documents.limit(0), targets)
    assert rows(empty.drawn) == [] and all(r.share is None for r in empty.shares.collect())
    assert rows(mix(documents, targets.limit(0)).drawn) == []


def test_plan():
    total, plans = plan([("a", 0.5, 1), ("b", 0.5, 3)], {"a": 100, "b": 20})
    assert total == 120 and plans["b"]["demand"] == 60
    assert abs(sum(p["tilt"] for p in plans.values())) < 1e-9
    assert all(abs(p["tilt"]) <= p["weight"] for p in plans.values())
    assert plan([], {}) == (0, {})


def test_running_sum(spark):
    data = [("hot", i, i % 5) for i in range(3000)] + [("b", i, 1) for i in range(10)]
    df = spark.createDataFrame(data, "g string, i int, v bigint").repartition(5)
    got = {(r.g, r.i): r.s for r in running_sum(df, "g", ["i"], "v", "s").collect()}
    want, sums = {}, {}
    for g, i, v in data:
        want[g, i] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    assert got == want


def test_long_text(spark):
    df = spark.createDataFrame([(1, "big", "word " * 100_000, 0), (2, "big", "x", 0)], DOCS)
    got = mix(df, spark.createDataFrame([("big", 1.0, 1)], TARGETS))
    assert got.shares.first().tokens_drawn > 100_000
