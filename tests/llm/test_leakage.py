import math
import random
import re
from collections import Counter

import numpy as np

from lodestone.llm.leakage import PASSAGE, common, leaks, passages_of, words

from ..conftest import DATA, rows

WORD = re.compile(r"[^\W_]+")


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = [x.lower() for x in WORD.findall(text or "")]
        for i, it in items:
            v = [x.lower() for x in WORD.findall(it or "")]
            n = min(13, len(v))
            runs = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                out.add((d, i))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary[: 80 + 5 * i]) for _ in range(rng.choice([4, 12, 13, 20, 60, 110])))) for i in range(1, 31)]
    docs = []
    for d in range(200):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))]
        if d % 3 == 0:
            source = rng.choice(items)[1].split()
            n = rng.choice([5, 12, 13, 14, 30])
            a = rng.randrange(max(1, len(source) - n + 1))
            at = rng.randrange(len(text))
            text[at:at] = source[a : a + n]
        docs.append((d, ", ".join(x.upper() if rng.random() < 0.1 else x for x in text)))
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
        assert sorted(rows(found.where("verbatim").select("doc_id", "item_id"))) == brute(docs, items)


def test_odd_rows(spark):
    item = " ".join(f"k{i}" for i in range(13))
    docs = [(1, None, "x"), (2, "", "x"), (3, "...", "x"), (4, item, "x"), (4, item, "y"), (5, "Ünï " * 50_000 + item.upper() + " end", "x"), (6, item.replace("k5", "k5 and"), "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "!?"), (10, "ünï ünï")], "item_id bigint, text string")
    got = rows(leaks(df, items).where("verbatim").select("doc_id", "item_id"))
    assert sorted(got) == [(4, 7), (5, 7), (5, 10)]
    assert rows(leaks(df.limit(0), items)) == []
    assert rows(leaks(df, items.limit(0))) == []


def test_paraphrase_is_reported_apart(spark):
    item = [f"rare{i}" for i in range(26)]
    told = [w if k % 6 else f"other{k}" for k, w in enumerate(item)]
    df = spark.createDataFrame([(1, " ".join(told)), (2, "nothing of it at all")], "doc_id bigint, text string")
    for items in ([(1, " ".join(item))], [(1, " ".join(item)), (2, "something else entirely with words")]):
        (r,) = leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
        assert (r.doc_id, r.item_id, r.verbatim) == (1, 1, False) and r.lcs >= 18


def lcs_of(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def paraphrased(docs, items):
    """All pairs of which a stretch of the document, wherever it begins, holds enough of the item in order and names it, but no case."""
    out = set()
    holders = Counter(w for _, it in items for w in set(words(it)))
    cases = set(brute(docs, items))
    for d, text in docs:
        w = words(text)
        for i, it in items:
            v = words(it)
            need = math.ceil(0.7 * min(26, len(v)))
            own = {x for x in v if holders[x] <= max(1, len(items) // 50)}
            if (d, i) in cases or len(own & set(w)) < 0.5 * min(4, len(own)):
                continue
            width = min(26, max(13, len(v)))
            stretches = (w[s : s + width] for s in range(max(1, len(w) - width + 1)))
            if any(sum(x in v for x in s) >= need and len(own & set(s)) >= 0.5 * max(1, min(4, len(own))) and lcs_of(s, v) >= need for s in stretches):
                out.add((d, i))
    return out


def test_recall_of_paraphrases(spark):
    """Wording with a fifth of the words replaced, at any place of real texts; recall against brute force is at least 0.9."""
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/eval_items.parquet").collect()][:60]
    texts = [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect() if r.text][:60]
    spoken = [w for t in texts for w in t.split()]
    docs = []
    for d, text in enumerate(texts):
        w = text.split()[:90]
        if d % 3:
            part = words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(part) - 29))
            part = [x if rng.random() < 0.85 else rng.choice(spoken) for x in part[a : a + 30] for x in ([x, rng.choice(spoken)] if rng.random() < 0.05 else [x])]
            at = rng.randrange(len(w))
            w[at:at] = part
        docs.append((d, " ".join(w)))
    want = paraphrased(docs, items)
    found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = set(rows(found.where("not verbatim").select("doc_id", "item_id")))
    assert len(want) >= 10 and got <= want
    assert len(got & want) >= 0.9 * len(want), (len(got & want), len(want))


def test_every_run_lies_in_a_passage():
    for n in list(range(1, 80)) + [1000]:
        doc, at = passages_of(np.array([n]))
        for s in range(max(1, n - 12)):
            assert any(a <= s and min(s + 13, n) <= a + PASSAGE for a in at), (n, s)


def test_common_words():
    rng = random.Random(5)
    a = np.array([[rng.randrange(4) for _ in range(26)] for _ in range(60)], dtype=np.int32)
    b = np.array([[rng.randrange(-1, 4) for _ in range(40)] for _ in range(60)], dtype=np.int32)
    lcs, run = common(a, b)
    for x, y, p, q in zip(a.tolist(), b.tolist(), lcs, run):
        table = [[0] * 41 for _ in range(27)]
        longest, streak = 0, [[0] * 41 for _ in range(27)]
        for i in range(26):
            for j in range(40):
                same = x[i] == y[j]
                table[i + 1][j + 1] = table[i][j] + 1 if same else max(table[i][j + 1], table[i + 1][j])
                streak[i + 1][j + 1] = streak[i][j] + 1 if same else 0
                longest = max(longest, streak[i + 1][j + 1])
        assert (p, q) == (table[26][40], longest)


def test_words():
    assert words("A_b-Cé9 ß") == ["a", "b", "cé9", "ß"]


def test_least_runs_among_rarer_words(spark):
    """13 everyday words of an item, set in the rarer words of others: their cosine is small."""
    everyday = [f"c{i}" for i in range(13)]
    items = [(1, " ".join(everyday))] + [(k, " ".join(f"r{k}x{j}" for j in range(26))) for k in range(2, 32)]
    docs = [(d, " ".join(random.Random(d).sample(everyday, 13) * 2)) for d in range(400)]
    for k in range(2, 32):
        rare = items[k - 1][1].split()
        docs.append((1000 + k, " ".join(rare[:12] + ["x"] + everyday + ["x"] + rare[14:])))
    found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    planted = rows(found.where("verbatim and doc_id > 1000").select("doc_id", "item_id", "cosine"))
    assert [(d, i) for d, i, _ in planted] == [(1000 + k, 1) for k in range(2, 32)]
    assert min(c for _, _, c in planted) < 0.3
    assert sorted(rows(found.where("verbatim").select("doc_id", "item_id"))) == brute(docs, items)
