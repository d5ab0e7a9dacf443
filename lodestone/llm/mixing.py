"""Mixing sources to target weights over a time-varying curriculum.

Every source has a weight schedule w(t) over training time t in [0, 1], linear with the target weight as its mean; at
every t the weights of all sources add up to 1. Its integral times the total is the source's cumulative token demand.
The copies of a source's documents are laid end to end in a hashed order of their own for every repetition; a copy
whose middle lies at cumulative token c is wanted at the time t at which the demand reaches c, found by inverting the
integral in closed form. Sorting all copies by that time by range gives the training order.

The running sums over a source of any size come from a range-partitioned sort: sums inside each partition, then the
prefix sums of the partitions' totals, of which there is one for each partition and source.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import join_small, ship, spread, stage

#: Vocabulary of the byte-level BPE that token counts are measured in: lines of base64 token and rank.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer pattern of that vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How far a schedule leans: 0 keeps all weights constant, 1 lets a weight go from twice its mean to nothing.
LEAN = 0.5
#: Most sources of a mixture; their plan is made on the driver.
MOST_SOURCES = 10_000

_ENCODINGS: dict[int, object] = {}


def _encoding(raw: bytes):
    key = hash(raw)
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def count_tokens(documents: DataFrame, doc_id: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens); the source without blanks around it and in lower case. A null text has 0 tokens."""
    with open(tokenizer, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(sent.value).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["doc_id", "source", "tokens"])

    picked = documents.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.lower(F.trim(F.col(f"`{source}`"))).alias("source"), F.col(f"`{text}`").alias("text")
    )
    return spread(picked).mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def plan(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None, lean: float = LEAN) -> tuple[int, dict[str, dict]]:
    """The total and, for each source, its plan.

    Weights of sources without tokens go to the others in proportion. Without ``total`` it is the largest at which every
    source that has tokens gets its share with no repetition beyond its cap; with a larger one, capped sources fall short.
    """
    present = {s: (w, r) for s, w, r in targets if w > 0 and r > 0 and available.get(s, 0) > 0}
    mass = sum(w for w, _ in present.values())
    if not present:
        return 0, {}
    if total is None:
        total = math.floor(min(r * available[s] / (w / mass) for s, (w, r) in present.items()) + 1e-6)
    plans = {}
    for s, (w, r) in present.items():
        share = w / mass
        plans[s] = {"weight": share, "demand": min(share * total, float(r * available[s])), "cap": r, "available": available[s]}
    # scarce sources, repeated most, lean towards the end
    rank = {s: min(1.0, p["demand"] / p["available"] / max(q["demand"] / q["available"] for q in plans.values())) for s, p in plans.items()}
    middle = sum(plans[s]["weight"] * rank[s] for s in plans)
    for s, p in plans.items():
        p["tilt"] = lean * p["weight"] * (rank[s] - middle)
    return int(total), plans


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group before this one, in ``order``; groups of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = np.array(batch.column(group).to_pylist(), dtype=object)
            v = batch.column(value).to_numpy().astype(np.int64)
            new = np.r_[groups[0] != last, groups[1:] != groups[:-1]]
            before = np.cumsum(v) - v
            at = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
            local = np.where(at >= 0, before - before[np.maximum(at, 0)], before + carry)
            carry, last = int(local[-1] + v[-1]), groups[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local), pa.array(np.full(len(v), part, np.int32))], names=[*batch.schema.names, "__ls_l", "__ls_p"]
            )

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    local = stage(ranged.mapInArrow(run, f"{kinds}, __ls_l bigint, __ls_p int"))
    totals = local.groupBy("__ls_p", group).agg(F.max(F.col("__ls_l") + F.col(value)).alias("__ls_t"))
    before = Window.partitionBy(group).orderBy("__ls_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__ls_p", group, F.coalesce(F.sum("__ls_t").over(before), F.lit(0)).alias("__ls_o"))
    return join_small(local, offsets, ["__ls_p", group], salt=order).withColumn(out, F.col("__ls_l") + F.col("__ls_o")).select(*df.columns, out)


class Mixture:
    """The draw and its report."""

    def __init__(self, drawn: DataFrame, shares: DataFrame):
        self.drawn, self.shares = drawn, shares


def mix(
    documents: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    total: int | None = None,
    lean: float = LEAN,
    seed: int = 11,
) -> Mixture:
    """Draw from ``documents`` so that every source of ``targets`` (source, target_weight, max_repeats) has its share.

    ``drawn``: doc_id, source, copy (from 1), tokens, position (of the copy's middle in the training stream, in tokens),
    sorted by position over all partitions. ``shares``: one row per target source with target_weight, documents and
    tokens there are, tokens drawn, share reached (null if nothing is drawn), and the most often a document is repeated.

    Sources are compared in lower case without blanks around them; of targets that then coincide the weights add up and
    the largest cap holds. Documents with a null or unlisted source, a null text or no tokens are never drawn. Documents
    that share an id are drawn apart. A source takes whole copies only while they fit into its demand, so it falls short
    by less than one copy. Empty tables give no draw and shares of null.
    """
    spark: SparkSession = documents.sparkSession
    ship(documents.sparkSession)
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_weight", "max_repeats").where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeats").cast("int").alias("max_repeats"))
    sized = stage(count_tokens(documents, doc_id, source, text, tokenizer).where("tokens > 0").withColumn("row", F.monotonically_increasing_id()))
    there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    listed = wanted.join(there, "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    all_tokens, plans = plan(
        [(r["source"], r["target_weight"] or 0.0, r["max_repeats"] or 0) for r in listed], {r["source"]: r["tokens"] or 0 for r in listed}, total, lean
    )
    each = spark.createDataFrame(
        [(s, p["weight"], p["tilt"], p["demand"], int(math.ceil(p["demand"] / p["available"] - 1e-9)), p["available"]) for s, p in sorted(plans.items())],
        "source string, __w double, __a double, __d double, __e int, __n bigint",
    )
    copies = (
        sized.join(F.broadcast(each), "source")  # at most MOST_SOURCES rows
        .select("doc_id", "row", "source", "tokens", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__e")))).alias("copy"))
        .withColumn("__h", F.xxhash64("row", "copy", F.lit(seed)))
    )
    summed = running_sum(copies, "source", ["copy", "__h", "row"], "tokens", "__s").join(F.broadcast(each), "source")
    kept = summed.where(F.col("__s") + F.col("tokens") <= F.col("__d") + F.lit(1e-6))
    c = (F.col("__s") + F.col("tokens") / F.lit(2.0)) / F.lit(float(max(all_tokens, 1)))
    lean_in = F.col("__w") - F.col("__a")
    t = F.lit(2.0) * c / (lean_in + F.sqrt(F.greatest(F.lit(0.0), lean_in * lean_in + F.lit(4.0) * F.col("__a") * c)))
    drawn = kept.select(
        "doc_id", "source", "copy", "tokens", F.floor(F.least(t, F.lit(1.0)) * F.lit(float(all_tokens))).cast("bigint").alias("position"), "row"
    )
    order = ["position", "source", "row", "copy"]
    shares = (
        drawn.groupBy("source").agg(F.sum("tokens").alias("drawn"), F.max("copy").alias("repeats"))
    )
    whole = shares.agg(F.sum("drawn").alias("whole"))
    listed_df = wanted.join(there, "source", "left")
    report = (
        listed_df.join(shares, "source", "left")
        .join(F.broadcast(whole))  # one row
        .select(
            "source",
            "target_weight",
            "max_repeats",
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("drawn", F.lit(0)).alias("tokens_drawn"),
            (F.coalesce("drawn", F.lit(0)) / F.col("whole")).alias("share"),
            F.coalesce("repeats", F.lit(0)).alias("repeats"),
        )
    )
    return Mixture(drawn.repartitionByRange(*order).sortWithinPartitions(*order).drop("row"), report)
