import math
import random

import pytest

from lodestone.operators.hotkeys import heavy_keys, key_profile

from .conftest import rows


def brute(data, probs, share=0.0):
    keys = {}
    for k, v in data:
        keys.setdefault(k, []).append(v)
    out = []
    for k, vs in keys.items():
        if len(vs) < share * len(data):
            continue
        good = sorted(v for v in vs if v is not None and not math.isnan(v))
        q = [good[max(1, math.ceil(p * len(good))) - 1] if good else None for p in probs]
        out.append((k, len(vs), len(good), *q))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bins", [2, 7, 256])
def test_against_brute_force(spark, bins):
    rng = random.Random(bins)
    data = [("hot", rng.gauss(0, 1e6)) for _ in range(600)] + [("even", float(i % 40)) for i in range(300)]
    data += [(f"k{rng.randrange(30)}", float(rng.randrange(5))) for _ in range(200)] + [(None, 1.0), (None, 2.0), ("none", None), ("nan", float("nan")), ("nan", 3.0)]
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(data, "k string, v double")
    assert rows(key_profile(df, ["k"], "v", probs, bins=bins)) == brute(data, probs)


def test_share_and_empty(spark):
    data = [("a", 1.0)] * 60 + [("b", float(i)) for i in range(39)] + [("c", 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    assert rows(key_profile(df, ["k"], "v", (0.5,), min_share=0.02)) == brute(data, (0.5,), 0.02)
    assert rows(key_profile(df.limit(0), ["k"], "v")) == []
    assert rows(key_profile(df.limit(0), ["k"], "v", min_share=0.1)) == []


def test_salted_join_gives_the_same(spark, monkeypatch):
    from lodestone.plans import staging

    monkeypatch.setattr(staging, "fits_broadcast", lambda *a, **k: False)
    data = [("hot", float(i * i % 997)) for i in range(500)] + [(None, float(i)) for i in range(9)]
    df = spark.createDataFrame(data, "k string, v double")
    assert rows(key_profile(df, ["k"], "v", (0.1, 0.5), bins=4)) == brute(data, (0.1, 0.5))


def test_two_part_keys_and_clashing_names(spark):
    data = [(1, None, 5, 0), (1, None, 7, 0), (1, "x", 9, 0), (None, "x", 2, 0)]
    df = spark.createDataFrame(data, "n int, id string, q0 int, n_values int")
    got = rows(key_profile(df, ["n", "id"], "q0", (0.5,)).toDF("a", "b", "c", "d", "e"))
    assert got == sorted([(1, None, 2, 2, 5.0), (1, "x", 1, 1, 9.0), (None, "x", 1, 1, 2.0)], key=repr)


@pytest.mark.parametrize("bins", [64])
def test_heavy_keys_against_counts(spark, bins):
    rng = random.Random(bins)
    data = [("a", None)] * 100 + [("b", 1)] * 10 + [(None, None)] * 9 + [(f"k{rng.randrange(500)}", rng.randrange(3)) for _ in range(881)]
    df = spark.createDataFrame(data, "k string, n int")
    for share in (0.001, 0.01, 0.1):
        counts = {}
        for x in data:
            counts[x] = counts.get(x, 0) + 1
        want = sorted(((*x, c) for x, c in counts.items() if c >= share * len(data)), key=repr)
        assert rows(heavy_keys(df, ["k", "n"], share, bins=bins).toDF("a", "b", "c")) == want
    assert rows(heavy_keys(df.limit(0), ["k"], 0.01)) == []
    assert rows(heavy_keys(df.limit(1), ["k"], 0.5)) == [("a", 1)]


def test_many_ranks_of_many_wide_keys(spark):
    rng = random.Random(3)
    data = [(f"k{i % 7}", float(rng.randrange(2000))) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = tuple(i / 20 for i in range(21))
    assert rows(key_profile(df, ["k"], "v", probs, bins=16)) == brute(data, probs)
