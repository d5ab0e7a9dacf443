import random
from datetime import datetime

from lodestone.llm.layout import Layout
from lodestone.llm.provenance import ascribed_to, copied_codes, foreign_files, heading, layout_kind, shingles

from ..conftest import rows

SCHEMA = "repo_id bigint, file_id string, path string, contents string, scanned_at timestamp, kind string"
T = datetime(2031, 1, 1)


def hand(seed, n=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    return "\n".join(f"export function {word()}({(a := word())}) {{\n  // {word()}\n  return {a}.{word()}({word()}, {word()});\n}}\n" for _ in range(n))


def generated(n):
    return "export class Q {\n" + "\n".join(f"  getField{i}() {{\n    return this.values[{i}];\n  }}\n" for i in range(n)) + "}\n"


def kinds(spark, files, names=((1, "own-name"), (2, "two"), (3, "three"))):
    df = spark.createDataFrame([(*f, T, "x") if len(f) == 4 else f for f in files], SCHEMA)
    got = foreign_files(df, spark.createDataFrame(list(names), "repo_id bigint, name string"))
    return {(r.repo_id, r.file_id): r.kind for r in got.collect()}


def test_kinds(spark):
    minified = "".join(f"var a{i}=function(b){{return b*{i}+a}};" for i in range(60))
    blob = "export const X = [\n" + "".join("  " + ", ".join(str(i * j % 99991) for j in range(12)) + ",\n" for i in range(60)) + "];\n"
    copied = hand(7)
    files = [
        (1, "own", "src/a.js", "// Copyright (c) 2030 the own-name contributors. All rights reserved.\n" + hand(1)),
        (1, "vendor-dir", "vendor/b.js", hand(2)),
        (1, "mentions", "c.js", hand(3) + '// The writer puts a "DO NOT EDIT" line on every generated file.\n'),
        (1, "min", "d.js", minified),
        (1, "data", "e.ts", blob),
        (1, "gen", "f.js", generated(12)),
        (1, "ascribed", "g.js", "// otherlib v1.2.3 | (c) The otherlib Authors | BSD licence\n" + hand(4)),
        (2, "copy", "h.js", copied),
        (3, "copy2", "i.js", "// changed here\n" + copied.replace("return", "return ", 1) + "\nexport const extra = 1;\n"),
        (3, "same-repo-1", "j.js", hand(8)),
        (3, "same-repo-2", "k.js", hand(8)),
        (3, "null", "l.js", None),
        (3, "empty", "m.js", " \n"),
        (3, "text", "n.md", "generated"),
        (3, "nopath", None, generated(9)),
    ]
    assert kinds(spark, files) == {
        (1, "min"): "minified", (1, "data"): "data", (1, "gen"): "generated", (1, "ascribed"): "vendored", (2, "copy"): "vendored", (3, "copy2"): "vendored",
    }
    assert kinds(spark, []) == {}


def test_newest_state_counts(spark):
    files = [(1, "a", "a.js", generated(9), datetime(2031, 1, 1), "x"), (1, "a", "a.js", hand(1), datetime(2031, 1, 2), "x")]
    assert kinds(spark, files) == {}


def test_ascription():
    assert ascribed_to(["// Originally published as x-kit 1.3.0; included under its own licence"]) == {"xkit"}
    assert ascribed_to(["// [abc 0.1.2] please send fixes upstream to the abc maintainers"]) == {"abc"}
    assert ascribed_to(["// falls back to the folder when no channel is left"]) == set()


def test_layout():
    text = "function f(a) {\n  return a;\n}\n"
    assert Layout(text, "js").expansion == 1.0
    assert Layout(text.replace("\n", ""), "js").lines == 1
    assert Layout("", "py").lines == 0 and Layout('"""never ends', "py").literal == 1.0
    assert Layout("x" * 200_000, "go").canonical == 2501


def test_copies_like_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for family in range(12):
        base = [f"w{family}_{i}" for i in range(120)]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 12])):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            texts.append((rng.randrange(1, 4), words))
    from lodestone.llm.provenance import bands

    grams = [set(shingles(w).tolist()) for _, w in texts]
    data = [(r, shingles(w).tolist(), bands(shingles(w))) for r, w in texts]
    df = spark.createDataFrame(data, "repo_id bigint, shingles array<bigint>, bands array<bigint>")
    got = {r[0] for r in copied_codes(df).collect()}
    ids = [r[0] for r in df.selectExpr("xxhash64(shingles)").collect()]
    near = [[len(a & b) / len(a | b) >= 0.8 for b in grams] for a in grams]
    must = {ids[i] for i in range(len(texts)) for j in range(len(texts)) if near[i][j] and texts[i][0] != texts[j][0]}
    # classes: a link may lead over others
    may, reach = set(), [{j for j in range(len(texts)) if near[i][j]} for i in range(len(texts))]
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            for j in reach[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        if len({texts[j][0] for j in seen}) > 1:
            may.add(ids[i])
    assert got <= may and len(got & must) >= 0.95 * len(must)
    assert rows(copied_codes(df.limit(0))) == []


def test_links_between_members_that_do_not_lead(spark):
    """In a large bucket of like files of one repository one has a foreign copy that is like none of the others."""
    data, want = [], []
    for family in range(5):
        base = set(range(family * 10_000, family * 10_000 + 100))
        low, new = min(base), family * 10_000 + 5000
        x = base - set(range(low, low + 10)) | set(range(new, new + 10))
        y = x - set(range(low + 20, low + 30)) | set(range(new + 20, new + 30))
        data += [(1, sorted(base - {low + k} | {new + 100 + k}), [family]) for k in range(100)] + [(1, sorted(x), [family]), (2, sorted(y), [family])]
        want += [sorted(x), sorted(y)]
    df = spark.createDataFrame(data, "repo_id bigint, shingles array<bigint>, bands array<bigint>")
    ids = {r[0] for r in spark.createDataFrame([(w,) for w in want], "s array<bigint>").selectExpr("xxhash64(s)").collect()}
    assert ids <= {r[0] for r in copied_codes(df).collect()}


def test_headings_of_any_length_and_small_files():
    text = "".join(f"// line {i}\n" for i in range(8)) + "// otherlib v1.2.3 | (c) The otherlib Authors\nexport const a = b;\n// not of the heading\n"
    head = heading(text, Layout(text, "js").comments)
    assert len(head) == 9 and ascribed_to(head) == {"otherlib"}
    small = "".join(f"var a{i}=b({i});" for i in range(40))[:380]
    assert layout_kind(Layout(small, "js"), []) in ("minified", "generated")
    assert layout_kind(Layout("export const X = [" + ", ".join(str(i * 7919) for i in range(40)) + "];\n", "js"), []) == "data"


def test_short_copies(spark):
    code = "export const limit = (a, b) => clamp(a, b, floor, ceiling);\n"
    assert kinds(spark, [(1, "x", "x.js", code), (2, "y", "y.js", code), (3, "z", "z.js", "export * from 'm';\n"), (1, "w", "w.js", "export * from 'm';\n")]) == {(1, "x"): "vendored", (2, "y"): "vendored"}
