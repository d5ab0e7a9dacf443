"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 text in any of its usual notations; without a zone it is UTC. Null if it can't be read."""
    trimmed = F.trim(text)
    zoned = F.when(trimmed.rlike(r"(?i)(Z|[+-]\d{2}(:?\d{2})?)$") & trimmed.rlike(r"\d{1,2}:\d{2}"), trimmed).otherwise(
        F.concat(trimmed, F.lit("Z"))
    )
    return F.unix_micros(F.when(trimmed.rlike(r"\d{1,2}:\d{2}"), zoned).otherwise(trimmed).try_cast("timestamp"))


def bare(text: Column) -> Column:
    """A text without the white space around it, tabs and line ends included; ``F.trim`` takes off spaces only."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def leaves(col: Column, kind: T.DataType) -> list[Column]:
    """Hashable columns that together tell any two values of ``col`` apart, nulls in any place included."""
    if isinstance(kind, T.StructType):
        return [col.isNull(), *[x for f in kind.fields for x in leaves(col.getField(f.name), f.dataType)]]
    if isinstance(kind, T.ArrayType):
        return [F.to_json(col)]
    if isinstance(kind, T.MapType):
        return [F.to_json(F.array_sort(F.map_entries(col)))]
    return [col.isNull(), col]


def cell_hash(col: Column, kind: T.DataType) -> Column:
    """A 62-bit hash of a value. Sums of two of them with either sign can't overflow."""
    return F.shiftright(F.xxhash64(*leaves(col, kind)), 2)


def round_half_up(x: Column, digits: int) -> Column:
    """Round half towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
