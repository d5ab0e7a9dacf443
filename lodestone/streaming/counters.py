"""Counts over edges that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.values import bare


def coupling_counts(edges: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Edges into each node, over a stream of (repo_id, id, target_id, arrived): each edge once within the watermark.

    Use it with ``outputMode("update")`` or ``complete``. Edges that come again after the watermark has passed count anew.
    """
    once = edges.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["repo_id", "id"])
    return once.groupBy("repo_id", bare(F.col("target_id")).alias("id")).agg(F.count(F.lit(1)).alias("incoming_edges"))
