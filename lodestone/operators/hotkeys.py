"""Per-key counts and exact quantiles when a few keys hold most rows, by distributed exact selection.

Rows are first counted by (key, value): mergeable counts, combined before the shuffle, so a hot key is never gathered.
A key with no more than ``bins`` distinct values has its exact histogram at once: a running sum over at most ``bins``
rows. For every other key ``select`` counts a histogram of ``bins`` equal steps over each range that holds a wanted rank,
takes the bin of the rank, and narrows the range to the values in it, until ranges are single values. A task never holds
more than ``bins`` rows of a key, and only keys with more than ``bins`` distinct values take part in a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import join_small, stage

#: Infinite values are read as this, the largest finite double, and its negative.
LARGEST = 1.7976931348623157e308


def _names(key: list[str]) -> list[str]:
    return [f"__ls_k{i}" for i in range(len(key))]


def _tag(ks: list[str]) -> Column:
    """A hash of a key, null parts included, to join by."""
    return F.xxhash64(F.lit(0), *[x for a in ks for x in (F.col(a).isNull(), F.col(a))])


def _same(ks: list[str], left: str, right: str) -> Column:
    parts = [F.col(f"{left}.{a}").eqNullSafe(F.col(f"{right}.{a}")) for a in ks]
    return reduce(lambda a, b: a & b, parts, F.col(f"{left}.__ls_t") == F.col(f"{right}.__ls_t"))


def _of_ranges(values: DataFrame, ranges: DataFrame, ks: list[str]) -> DataFrame:
    """Each value with the range of its key that it lies in. The ranges of a key don't overlap, so rows aren't multiplied."""
    left = values.select("__ls_t", *[F.col(a).alias(f"__ls_x{j}") for j, a in enumerate(ks)], "__ls_v", "__ls_c")
    joined = join_small(left, ranges, ["__ls_t"], salt=["__ls_v"])
    match = [F.col(f"__ls_x{j}").eqNullSafe(F.col(a)) for j, a in enumerate(ks)]
    return joined.where(reduce(lambda a, b: a & b, match, F.col("__ls_v").between(F.col("__ls_lo"), F.col("__ls_hi"))))


def select(values: DataFrame, wanted: DataFrame, ks: list[str], bins: int) -> DataFrame:
    """The values at wanted ranks, by refining histograms: (__ls_t, ks, __ls_i, __ls_q).

    values: __ls_t (``_tag`` of the key), ks, __ls_v, __ls_c (rows with that value; a value occurs once for each key).
    wanted: __ls_t, ks, __ls_i (which rank), __ls_rank, __ls_lo, __ls_hi (least and greatest value of the key).
    """
    done = []
    while wanted.limit(1).count():
        ranges = wanted.select("__ls_t", *ks, "__ls_lo", "__ls_hi").distinct()
        width = F.col("__ls_hi") / F.lit(float(bins)) - F.col("__ls_lo") / F.lit(float(bins))
        place = F.floor(F.col("__ls_v") / F.when(width > 0, width) - F.col("__ls_lo") / F.when(width > 0, width)).cast("int")
        step = F.when(F.col("__ls_v") >= F.col("__ls_hi"), F.lit(bins - 1)).otherwise(F.least(F.lit(bins - 1), place))
        own = ["__ls_t", *ks, "__ls_lo", "__ls_hi"]
        up = Window.partitionBy(*own).orderBy("__ls_b").rowsBetween(Window.unboundedPreceding, 0)
        histogram = (
            _of_ranges(values, ranges, ks)
            .groupBy(*own, F.coalesce(step, F.lit(0)).alias("__ls_b"))
            .agg(F.sum("__ls_c").alias("__ls_c"), F.min("__ls_v").alias("__ls_from"), F.max("__ls_v").alias("__ls_to"))
            .withColumn("__ls_u", F.sum("__ls_c").over(up))
        )
        l, r = wanted.alias("l"), histogram.alias("r")
        inside = (F.col("l.__ls_rank") <= F.col("r.__ls_u")) & (F.col("l.__ls_rank") > F.col("r.__ls_u") - F.col("r.__ls_c"))
        range_of = (F.col("l.__ls_lo") == F.col("r.__ls_lo")) & (F.col("l.__ls_hi") == F.col("r.__ls_hi"))
        chosen = stage(
            l.join(r, _same(ks, "l", "r") & range_of & inside).select(
                "l.__ls_t",
                *[f"l.{a}" for a in ks],
                "l.__ls_i",
                (F.col("l.__ls_rank") - F.col("r.__ls_u") + F.col("r.__ls_c")).alias("__ls_rank"),
                F.col("r.__ls_from").alias("__ls_lo"),
                F.col("r.__ls_to").alias("__ls_hi"),
            )
        )
        done.append(chosen.where("__ls_lo = __ls_hi").select("__ls_t", *ks, "__ls_i", F.col("__ls_lo").alias("__ls_q")))
        wanted = chosen.where("__ls_lo < __ls_hi")
    if not done:
        return wanted.select("__ls_t", *ks, "__ls_i", F.col("__ls_lo").alias("__ls_q"))
    return reduce(DataFrame.unionByName, done)


def _rank(p: float, size: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col(size))).cast("bigint")


def key_profile(
    df: DataFrame,
    key: list[str],
    value: str,
    probs: tuple[float, ...] = (0.5,),
    *,
    min_share: float = 0.0,
    bins: int = 256,
) -> DataFrame:
    """For each key: its columns, ``n`` (rows), ``n_values`` (rows with a value), and ``q0``, ``q1``, ... at ``probs``.

    A quantile is the nearest-rank one: the smallest value with at least ``ceil(p * n_values)`` values up to it (the
    least value for p = 0); null when the key has no value. Null and NaN values count in ``n`` only. A null key is a key
    like any other. Values are compared as doubles. Keys that hold less than ``min_share`` of all rows are left out. An empty input gives no rows.
    """
    number = F.greatest(F.least(F.col(f"`{value}`").cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    known = F.col(f"`{value}`").isNotNull() & ~F.isnan(F.col(f"`{value}`").cast("double"))
    ks = _names(key)
    own = [F.col(f"`{k}`").alias(a) for k, a in zip(key, ks)]
    counted = stage(df.select(*own, F.when(known, number).alias("__ls_v")).groupBy(*ks, "__ls_v").agg(F.count(F.lit(1)).alias("__ls_c")))
    counted = counted.withColumn("__ls_t", _tag(ks))
    keys = counted.groupBy("__ls_t", *ks).agg(
        F.sum("__ls_c").alias("__ls_n"),
        F.coalesce(F.sum(F.when(F.col("__ls_v").isNotNull(), F.col("__ls_c"))), F.lit(0)).alias("__ls_m"),
        F.count("__ls_v").alias("__ls_d"),
        F.min("__ls_v").alias("__ls_lo"),
        F.max("__ls_v").alias("__ls_hi"),
    )
    least = 0.0
    if min_share > 0:
        least = min_share * (counted.agg(F.sum("__ls_c")).first()[0] or 0)
        # at most 1 / min_share keys are left
        kept = stage(keys.where(F.col("__ls_n") >= least))
        counted = join_small(counted, kept.select("__ls_t").distinct(), ["__ls_t"], "left_semi", salt=["__ls_v"])
        keys = kept
    wide = stage(keys.where(F.col("__ls_d") > bins))
    if wide.limit(1).count():
        # keys with the tag of a wide one (itself, but for a collision of hashes) are resolved with it
        tags = wide.select("__ls_t").distinct()
        inside = stage(join_small(counted, tags, ["__ls_t"], "left_semi", salt=["__ls_v"]))
        counted = join_small(counted, tags, ["__ls_t"], "left_anti", salt=["__ls_v"])
        sized = stage(join_small(keys, tags, ["__ls_t"], "left_semi", salt=ks or ["__ls_t"]))
        ranks = F.posexplode(F.array(*[_rank(p, "__ls_m") for p in probs])).alias("__ls_i", "__ls_rank")
        wanted = sized.where("__ls_m > 0").select("__ls_t", *ks, "__ls_lo", "__ls_hi", ranks)
        found = select(inside.where("__ls_v is not null"), wanted, ks, bins)
        pivoted = found.groupBy("__ls_t", *ks).agg(*[F.max(F.when(F.col("__ls_i") == i, F.col("__ls_q"))).alias(f"q{i}") for i in range(len(probs))])
        hot = sized.alias("l").join(pivoted.alias("r"), _same(ks, "l", "r"), "left").select(*[f"l.{a}" for a in ks], "l.__ls_n", "l.__ls_m", *[f"r.q{i}" for i in range(len(probs))])
    else:
        hot = None
    whole = Window.partitionBy("__ls_t", *ks)
    up = whole.orderBy(F.col("__ls_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("__ls_u", F.sum("__ls_c").over(up)).withColumn("__ls_m", F.sum(F.when(F.col("__ls_v").isNotNull(), F.col("__ls_c"))).over(whole))
    at = [F.when(F.col("__ls_v").isNotNull() & (F.col("__ls_u") >= _rank(p, "__ls_m")), F.col("__ls_v")) for p in probs]
    cold = (
        running.groupBy("__ls_t", *ks)
        .agg(F.sum("__ls_c").alias("__ls_n"), F.coalesce(F.max("__ls_m"), F.lit(0)).alias("__ls_m"), *[F.min(a).alias(f"q{i}") for i, a in enumerate(at)])
        .where(F.col("__ls_n") >= least)
        .drop("__ls_t")
    )
    every = cold if hot is None else cold.unionByName(hot)
    return every.select(*[F.col(a).alias(k) for a, k in zip(ks, key)], F.col("__ls_n").alias("n"), F.col("__ls_m").alias("n_values"), *[f"q{i}" for i in range(len(probs))])


def heavy_keys(df: DataFrame, key: list[str], share: float, *, bins: int = 256) -> DataFrame:
    """The keys that hold at least ``share`` of all rows, with ``n``, their rows; found by exact selection.

    Rows sorted by a number of their key lie in runs, one for each key. A key with ``least = ceil(share * rows)`` rows or
    more has a run that covers a multiple of ``least``; so the keys at these ranks, at most ``1 / share``, hold all heavy
    ones, and their exact counts tell which are. The number is 53 bits of a hash; keys that share one lie in one run and
    are told apart by their own counts. A null key is a key like any other. An empty input gives no rows.
    """
    if not 0 < share <= 1:
        raise ValueError(f"share {share} isn't in (0, 1]")
    ks = _names(key)
    own = [F.col(f"`{k}`").alias(a) for k, a in zip(key, ks)]
    counted = stage(df.select(*own).groupBy(*ks).agg(F.count(F.lit(1)).alias("__ls_c")).withColumn("__ls_v", F.shiftrightunsigned(_tag(ks), 11).cast("double")))
    runs = counted.groupBy("__ls_v").agg(F.sum("__ls_c").alias("__ls_c")).withColumn("__ls_t", F.lit(0).cast("bigint"))
    whole = runs.agg(F.sum("__ls_c").alias("n"), F.min("__ls_v").alias("lo"), F.max("__ls_v").alias("hi")).first()
    total = whole["n"] or 0
    least = max(1, -int(-share * total // 1))
    while least > 1 and least - 1 >= share * total:  # the product may have been rounded up
        least -= 1
    spark = df.sparkSession
    wanted = stage(spark.range(1 if total else 0).select(
        F.lit(0).cast("bigint").alias("__ls_t"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(max(1, total // least)).cast("bigint"))).alias("__ls_i"),
        F.lit(whole["lo"]).cast("double").alias("__ls_lo"),
        F.lit(whole["hi"]).cast("double").alias("__ls_hi"),
    ).withColumn("__ls_rank", F.col("__ls_i") * F.lit(least).cast("bigint")))
    at = select(stage(runs), wanted, [], bins).select(F.col("__ls_q").alias("__ls_v")).distinct()
    picked = counted.join(F.broadcast(at), "__ls_v", "left_semi")  # at most 1 / share values
    return picked.where(F.col("__ls_c") >= least).select(*[F.col(a).alias(k) for a, k in zip(ks, key)], F.col("__ls_c").alias("n"))
