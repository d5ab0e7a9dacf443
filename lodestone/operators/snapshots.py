"""What changed between full snapshots.

Every standing row of a snapshot is laid out as cells: one key-presence marker and one cell for each field, holding a
hash of the value. A snapshot's cells count +1 towards the step that leads to it and -1 towards the step that leads away
from it. The cells of a field stay in one column while they are summed, so that all grouped sums of a key come from a
single hash aggregate; afterwards the nonzero sums are unpivoted into field names. A presence sum of +1 is an added
key, -1 a removed one; at 0 any nonzero field sum makes it a changed one.

One shuffle, by series and key, serves everything: picking the standing rows, the signed sums and the unpivot. A key has
as many rows as there are snapshots of it, so no series, however large, makes a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.values import cell_hash
from lodestone.plans.staging import join_small


def snapshot_steps(delivered: DataFrame, snapshots: DataFrame, series: list[str], snapshot: str, instant: str) -> DataFrame:
    """Order the delivered snapshots of each series by instant, then id: (series, snapshot, next snapshot, whether it is the first).

    A snapshot listed more than once takes its latest instant; one with a null instant can't be placed and is left out.
    """
    listed = snapshots.groupBy(*series, snapshot).agg(F.max(instant).alias("__ls_at")).where("__ls_at is not null")
    order = Window.partitionBy(*series).orderBy("__ls_at", snapshot)
    return (
        delivered.select(*series, snapshot)
        .distinct()
        .join(listed, [*series, snapshot])
        .select(
            *series,
            snapshot,
            F.lead(snapshot).over(order).alias("__ls_next"),
            F.lag(F.lit(1)).over(order).isNull().alias("__ls_first"),
        )
    )


def snapshot_changes(
    rows: DataFrame,
    snapshots: DataFrame,
    *,
    series: list[str],
    snapshot: str,
    key: list[str],
    version: str,
    instant: str,
) -> DataFrame:
    """Changes between consecutive full snapshots.

    rows: full snapshots with ``series``, ``snapshot``, ``key`` and ``version`` columns; all others are compared fields.
    snapshots: (series, snapshot, ``instant``) of every snapshot that may have rows.
    Result: series, snapshot (the later one), key, ``change`` (added, removed, changed), ``changed_fields`` (sorted names;
    empty unless changed).

    Of several rows of a key in a snapshot the one with the greatest version stands (null lowest; a tie goes to the
    greatest content hash, so the result doesn't depend on row order). Nulls equal nulls, also inside structs and arrays,
    and a null key part is a key value like any other. Rows of snapshots that aren't listed, or have a null series, are
    left out. An empty input gives an empty result. Values are compared by 62 bits of hash per field.
    """
    steps = snapshot_steps(rows, snapshots, series, snapshot, instant)
    rest = [f for f in rows.schema.fields if f.name not in {*series, snapshot, *key, version}]
    placed = join_small(rows, steps, [*series, snapshot], salt=key)
    cells = [f"__ls_c{i}" for i in range(len(rest))]
    hashed = placed.repartition(*series, *key).select(
        *series,
        *key,
        snapshot,
        version,
        "__ls_next",
        "__ls_first",
        *[cell_hash(F.col(f"`{f.name}`"), f.dataType).alias(c) for f, c in zip(rest, cells)],
    )
    newest = Window.partitionBy(*series, *key, snapshot).orderBy(F.col(version).desc_nulls_last(), *[F.col(c).desc() for c in cells])
    standing = hashed.withColumn("__ls_r", F.row_number().over(newest)).where("__ls_r = 1")
    ways = F.array(
        F.when(~F.col("__ls_first"), F.struct(F.col(snapshot).alias("step"), F.lit(1).cast("bigint").alias("sign"))),
        F.when(F.col("__ls_next").isNotNull(), F.struct(F.col("__ls_next").alias("step"), F.lit(-1).cast("bigint").alias("sign"))),
    )
    signed = standing.select(*series, *key, *cells, F.explode(ways).alias("__ls_w")).where("__ls_w is not null")
    summed = signed.groupBy(*series, *key, F.col("__ls_w.step").alias("__ls_step")).agg(
        F.sum("__ls_w.sign").alias("__ls_presence"),
        *[F.sum(F.col(c) * F.col("__ls_w.sign")).alias(c) for c in cells],
    )
    nonzero = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) != 0, F.lit(f.name)) for f, c in zip(rest, cells)])))
    fields = F.when(F.col("__ls_presence") == 0, nonzero).otherwise(F.array().cast("array<string>"))
    change = F.when(F.col("__ls_presence") > 0, "added").when(F.col("__ls_presence") < 0, "removed").otherwise("changed")
    return (
        summed.withColumn("__ls_f", fields)
        .where((F.col("__ls_presence") != 0) | (F.size("__ls_f") > 0))
        .select(*series, F.col("__ls_step").alias(snapshot), *key, change.alias("change"), F.col("__ls_f").alias("changed_fields"))
    )
