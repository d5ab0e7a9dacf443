"""Top N rows within every group by one global sort, however unequal the groups are.

Rows are range-partitioned on (group, order) and sorted inside each partition, so a group of any size lies over as many
tasks as it needs. Each partition numbers its rows within a group and counts them; the counts of a group's earlier
partitions, prefix-summed, turn the local numbers into exact positions. Only rows whose local number is at most N leave
a partition, since their position can only be greater.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.staging import ship


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it; the first always does."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new[1:] |= differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return new


def _number(n: int, groups: int):
    """Numbers sorted rows within their group; gives rows up to ``n`` (kind 0) and one count for each group (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None  # the last row seen
        seen = 0  # rows of its group so far

        def out(batch: pa.RecordBatch, kind: int, local: np.ndarray) -> pa.RecordBatch:
            size = batch.num_rows
            extra = [pa.array(np.full(size, part, np.int32)), pa.array(np.full(size, kind, np.int32)), pa.array(local.astype(np.int64))]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "__ls_p", "__ls_k", "__ls_n"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if last is None:
                new = _starts(batch.columns[:groups])
                seen = 0
            else:
                both = [pa.concat_arrays([last.column(i), batch.column(i)]) for i in range(groups)]
                new = _starts(both)[1:]
            size = batch.num_rows
            begin = np.flatnonzero(new)
            head = begin[0] if len(begin) else size
            number = np.arange(1, size + 1)
            base = np.maximum.accumulate(np.where(new, np.arange(size), -1))
            number = np.where(base >= 0, number - base, number + seen)
            # groups that ended before a start in this batch
            if last is not None and len(begin):
                yield out(last, 1, np.array([seen + head]))
            if len(begin) > 1:
                ends = begin[1:] - 1
                yield out(batch.take(pa.array(ends)), 1, number[ends])
            keep = number <= n
            if keep.any():
                yield out(batch.filter(pa.array(keep)), 0, number[keep])
            seen = int(number[-1])
            last = batch.slice(size - 1, 1)
        if last is not None:
            yield out(last, 1, np.array([seen]))

    return run


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, position: str = "position") -> DataFrame:
    """The first ``n`` rows of each ``group`` by ``order``, with their exact 1-based ``position``.

    The order should end in an identifier; rows that tie in all of it are kept by position in no defined order, and
    repeated rows count each. A null group value is a group of its own. Use ``desc_nulls_last`` and the like to place
    nulls. An empty input gives an empty result; further columns pass through. ``n`` below 1 gives no rows.
    """
    ship(df.sparkSession)
    names = [*group, *[c for c in df.columns if c not in group]]
    ordered = df.select(*names)
    keys = [*[F.col(f"`{g}`").asc_nulls_first() for g in group], *order]
    ranged = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType(
        [*[T.StructField(f.name, f.dataType, True) for f in ordered.schema.fields]]
        + [T.StructField("__ls_p", T.IntegerType()), T.StructField("__ls_k", T.IntegerType()), T.StructField("__ls_n", T.LongType())]
    )
    local = ranged.mapInArrow(_number(n, len(group)), schema)
    before = Window.partitionBy(*group).orderBy("__ls_p").rangeBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.when(F.col("__ls_k") == 1, F.col("__ls_n"))).over(before), F.lit(0))
    return (
        local.withColumn(position, offset + F.col("__ls_n"))
        .where((F.col("__ls_k") == 0) & (F.col(position) <= n))
        .select(*df.columns, position)
    )
