"""Standing rows: the newest state of each key in a table delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def standing(df: DataFrame, key: list[str], version: str, tie: list[Column] | None = None) -> DataFrame:
    """Keep, of the rows of each key, the one with the greatest version (null lowest), then by ``tie``.

    Without ``tie`` equal versions go to the row with the greatest hash of its atomic columns, so the choice doesn't
    depend on row order. All rows of a key come to one task: keys are identifiers with few copies, not groups.
    """
    if tie is None:
        atomic = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "binary", "variant"))]
        tie = [F.xxhash64(*[F.col(f"`{c}`") for c in atomic]).desc()]
    order = Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), *tie)
    return df.withColumn("__ls_r", F.row_number().over(order)).where("__ls_r = 1").drop("__ls_r")
