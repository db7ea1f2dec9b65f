"""First-wins dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, order: list[str], seen: str = "duplicate") -> DataFrame:
    """df with a flag on every row but the first of each key."""
    return df.withColumn(seen, F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def grouped_digest(value) -> object:
    """The SHA-256 of a string column as eight groups of eight hex digits."""
    return F.array_join(F.regexp_extract_all(F.sha2(value, 256), F.lit("(.{8})"), F.lit(1)), ":")


def reference(source_id) -> object:
    return F.concat(F.lit("conv:"), grouped_digest(F.concat(F.lit("chatgpt:"), source_id)))
