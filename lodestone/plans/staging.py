"""Cutting lineage and joining small tables, both safe on a cluster that loses executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows ...
BROADCAST_ROWS = 100_000
#: ... and at most this many bytes, estimated from its column types and measured string lengths. The hash relation that is built
#: from it takes some four times as much.
BROADCAST_BYTES = 8 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each application; operators with Python code call it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lodestone-code-")  # the driver serves the file; executors fetch their own copy
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(f"{folder}/{root.name}.zip")
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local one is made in local mode; a cluster is refused."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = getattr(shared_dir, "local", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, known, True)
        shared_dir.local = known
    return f"file://{known}"


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut of lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy for each row.

    Only an input of fewer splits than cores is shuffled, which is small by that; a larger one stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``small``: its rows and the bytes of its strings, in one aggregate."""
    strings = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c, t in small.dtypes if t == "string"]
    row = small.agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(strings)]).first()
    return row["n"] <= max_rows and row["n"] * 8 * (len(small.columns) + 2) + sum(row[1:]) <= max_bytes


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    salt: list[str],
    salts: int = 32,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a table whose key may be hot with a side that has few rows for each key.

    The side is measured. Within the bound it is broadcast; beyond it every row of ``big`` gets one of ``salts`` salts
    from the hash of its ``salt`` columns and the side is repeated for each salt, so that a key that holds a third of all
    rows is spread over ``salts`` tasks. Both ways give the same rows.
    """
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    name = "__ls_salt"
    spread = big.withColumn(name, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in salt]), F.lit(salts)).cast("int"))
    repeated = small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, name], how).drop(name)
