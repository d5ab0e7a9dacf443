"""Source files that weren't written by hand in their repository.

Every file is lexed, its canonical form emitted, and the layout compared with it (``layout.Layout``):

* ``minified``: the canonical form has more than ``EXPANSION`` times the lines.
* ``data``: literals make up ``LITERAL`` of the code.
* ``generated``: ``UNIFORM`` of the canonical lines have a shape that repeats, numbers put aside; half of that is enough
  under a heading that says so.
* ``vendored``: the heading ascribes the file to a project other than the repository, or its code is a near copy (five
  words, similarity 0.8) of a file of another repository. Code of fewer than five words has no shingle and no copies.

Near copies are classes: files with the same code first, then, by MinHash bands, links of similar code. In a band's
bucket all are compared with a few leaders at a time, until all have led or all are found to be copies. No member leaves
before that, so no link between repositories goes untested, and no bucket is expanded into pairs at once. After the first
leaders a bucket of one repository is done: its links can't name another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.layout import LEXERS, Layout
from lodestone.plans.staging import join_small, ship, stage
from lodestone.plans.standing import standing

EXPANSION, LITERAL, UNIFORM = 4.0, 0.65, 0.8
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 8
#: Leaders of a bucket that its members are compared with in one round.
LEADERS = 16

_MARK = re.compile(r"(?i)@generated|auto-?\s?generated|(?:code|file|source)\s+(?:was\s+)?(?:automatically\s+)?generated|generated by|do not edit|automatically created|was produced by")
_CUE = re.compile(r"(?i)licen[cs]e|upstream|copyright|\(c\)|permission|redistribut|is part of|all rights|authors|maintainers|release")
_NAMES = (
    re.compile(r"(?i)\bthe\s+([a-z][\w.-]*)\s+(?:contributors|authors|project|maintainers|team|developers)\b"),
    re.compile(r"(?i)\b([a-z][\w-]*(?:\.(?:js|ts|py|go|java|css))?)\s+(?:--\s+)?(?:release\s+|version\s+|v)?\d+\.\d+(?:\.\d+)?\b"),
)
_SUFFIX = re.compile(r"\.(?:js|ts|py|go|java|css)$")
_NOT_NAMES = frozenset("version release revision since python node java go licence license v apache mozilla http".split())


def ascribed_to(comments: list[str]) -> set[str]:
    """Projects that the heading names as its origin, in lower case and without signs."""
    text = "\n".join(comments)
    if not _CUE.search(text):
        return set()
    found = {_SUFFIX.sub("", m.lower()) for pattern in _NAMES for m in pattern.findall(text)} - _NOT_NAMES
    return {re.sub(r"[^a-z0-9]", "", x) for x in found} - {""}


def heading(text: str, comments: list[str]) -> list[str]:
    """All comments before the code; those that follow its first lines belong to declarations."""
    out, at = [], 0
    for c in comments:
        place = text.find(c, at)
        if text[at:place].strip():
            break
        out.append(c)
        at = place + len(c)
    return out


def layout_kind(layout: Layout, head: list[str]) -> str | None:
    if layout.literal >= LITERAL:
        return "data"
    if layout.expansion > EXPANSION:
        return "minified"
    if layout.uniformity >= UNIFORM or (layout.uniformity >= UNIFORM / 2 and any(_MARK.search(c) for c in head)):
        return "generated"
    return None


def shingles(words: list[str]) -> np.ndarray:
    """Distinct hashes of all runs of five words, sorted."""
    if len(words) < WORDS:
        return np.zeros(0, dtype=np.int64)
    h = {xxhash.xxh64_intdigest("\x1f".join(words[i : i + WORDS])) for i in range(len(words) - WORDS + 1)}
    return np.sort(np.fromiter(h, dtype=np.uint64, count=len(h)).view(np.int64))


def bands(hashes: np.ndarray) -> list[int]:
    """MinHash bands: ``BANDS`` hashes of ``ROWS`` minima each."""
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
    x = hashes.view(np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(x), 4096):
        part = x[k : k + 4096, None] * a[None, :] + b[None, :]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes()) - (1 << 63) for i in range(BANDS)]


_FEATURES = (
    "repo_id bigint, file_id string, extension string, kind string, origins array<string>, expansion double, uniformity double, "
    "literal double, code bigint, shingles array<bigint>, bands array<bigint>"
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for repo, file, extension, text in zip(*[batch.column(c).to_pylist() for c in ("repo_id", "file_id", "extension", "contents")]):
            layout = Layout(text, extension)
            head = heading(text, layout.comments)
            kind = layout_kind(layout, head)
            grams = shingles(layout.words) if kind is None else np.zeros(0, dtype=np.int64)
            rows.append(
                (repo, file, extension, kind, sorted(ascribed_to(head)), layout.expansion, layout.uniformity, layout.literal, layout.code, grams.tolist(), bands(grams) if len(grams) else [])
            )
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = list(zip(*rows)) if rows else [[] for _ in types]
        names = ["repo_id", "file_id", "extension", "kind", "origins", "expansion", "uniformity", "literal", "code", "shingles", "bands"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def copied_codes(features: DataFrame) -> DataFrame:
    """Codes (hashes of shingle sets) of which there is a near copy in more than one repository: ``code_id``."""
    coded = features.where("size(shingles) > 0").select("repo_id", F.xxhash64("shingles").alias("code_id"), "shingles", "bands")
    repos = coded.groupBy("code_id").agg(F.min("repo_id").alias("lo"), F.max("repo_id").alias("hi"))
    sets = stage(coded.dropDuplicates(["code_id"]).drop("repo_id").join(repos, "code_id"))
    found = [sets.where("lo < hi").select("code_id")]

    slots = sets.select("code_id", "lo", "hi", F.size("shingles").alias("n"), F.posexplode("bands").alias("band", "value"))
    first = Window.partitionBy("band", "value").orderBy(F.xxhash64("code_id", "band"), "code_id")
    crowded = slots.groupBy("band", "value").count().where("count > 1").drop("count")
    members = stage(slots.join(crowded, ["band", "value"]).withColumn("r", F.row_number().over(first)))
    led = 0
    while members.limit(1).count():
        leaders = members.where((F.col("r") > led) & (F.col("r") <= led + LEADERS)).select("band", "value", F.col("code_id").alias("leader"), F.col("n").alias("n2"))
        led += LEADERS
        met = members.join(leaders, ["band", "value"]).where("code_id != leader")
        met = met.where(F.least("n", "n2") >= SIMILARITY * F.greatest("n", "n2"))  # else their sets can't be that similar
        pairs = met.select("code_id", "leader").distinct()
        left = sets.select("code_id", F.col("shingles").alias("a"), "lo", "hi")
        right = sets.select(F.col("code_id").alias("leader"), F.col("shingles").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        both = F.size(F.array_intersect("a", "b"))
        linked = stage(
            pairs.join(left, "code_id")
            .join(right, "leader")
            .withColumn("both", both)
            .where(F.col("both") >= SIMILARITY * (F.size("a") + F.size("b") - F.col("both")))
            .select("code_id", "leader", "lo", "hi", "lo2", "hi2")
        )
        spread = linked.groupBy("leader").agg(F.least(F.min("lo"), F.min("lo2")).alias("lo"), F.greatest(F.max("hi"), F.max("hi2")).alias("hi"))
        spread = spread.where("lo < hi").select("leader")
        found.append(stage(linked.join(spread, "leader", "left_semi").select("code_id").unionByName(spread.select(F.col("leader").alias("code_id"))).distinct()))
        # a bucket goes on while members are left to lead, it has more than one repository, and a member isn't found yet
        known = reduce(DataFrame.unionByName, found).distinct().withColumn("known", F.lit(True))
        going = (
            members.join(known, "code_id", "left")
            .groupBy("band", "value")
            .agg(F.max("r").alias("last"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.count_if(F.col("known").isNull()).alias("unknown"))
            .where((F.col("last") > led) & (F.col("least") < F.col("most")) & (F.col("unknown") > 0))
        )
        members = stage(members.join(going.select("band", "value"), ["band", "value"], "left_semi"))
    return reduce(DataFrame.unionByName, found).distinct()


def foreign_files(files: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repo_id, file_id, extension, kind): files that weren't written by hand in their repository; kind as above.

    files: repo_id, file_id, path, contents, scanned_at; the row with the greatest scanned_at stands, at equal times the
    one whose contents have the greater hash. repositories: repo_id, name. Null or blank contents, null paths and
    extensions without a lexer give no row; a repository without a name can't claim a heading as its own. Copies inside
    one repository don't count as copied. Very long files are lexed whole. Extra columns are ignored; empty tables give
    an empty result.
    """
    ship(files.sparkSession)
    extension = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1))
    picked = files.where(extension.isin(*LEXERS)).select(
        F.col("repo_id").cast("bigint").alias("repo_id"), "file_id", extension.alias("extension"), "contents", "scanned_at", F.xxhash64("contents").alias("tie")
    )
    newest = standing(picked, ["repo_id", "file_id"], "scanned_at", [F.col("tie").desc()]).where("trim(contents) != ''")
    features = stage(newest.select("repo_id", "file_id", "extension", "contents").mapInArrow(_features, _FEATURES))
    names = repositories.groupBy(F.col("repo_id").cast("bigint").alias("repo_id")).agg(
        F.collect_set(F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")).alias("names")
    )
    own = join_small(
        features.where("kind is null and size(origins) > 0").select("repo_id", "file_id", "extension", "origins"),
        names.select("repo_id", F.concat_ws(" ", "names").alias("names")),
        ["repo_id"],
        "left",
        salt=["file_id"],
    )
    ascribed = own.where(F.size(F.array_except("origins", F.split(F.coalesce("names", F.lit("")), " "))) > 0)
    copies = features.withColumn("code_id", F.xxhash64("shingles")).where("size(shingles) > 0").join(copied_codes(features), "code_id", "left_semi")
    vendored = ascribed.select("repo_id", "file_id", "extension").unionByName(copies.select("repo_id", "file_id", "extension")).distinct()
    return (
        features.where("kind is not null")
        .select("repo_id", "file_id", "extension", "kind")
        .unionByName(vendored.withColumn("kind", F.lit("vendored")))
    )
