"""Export files that keep arriving in a folder, as a stream.

Items are split, parsed and referenced as in the batch plan. First-wins dedup
is by arrival: a reference that any earlier batch held is a duplicate, for as
long as the query's state lives (the horizon is the run, so no watermark).
Counters come batch by batch through foreachBatch, which runs the batch plan and keeps
the references of each batch in a folder; those of earlier batches make duplicates. A
batch that is run again after a failure writes its references anew and doesn't see them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import dedup
from ..plans import curate
from ..sources import export

FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.json").load(folder)


def canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical rows of every item that arrives; files that would end a run give none."""
    return export.canonicalized(export.split_files(files(spark, folder)))


def first_arrivals(rows: DataFrame) -> DataFrame:
    """The parsed items whose reference hasn't come before."""
    return rows.where("failure IS NULL").withColumn("ref", dedup.reference(F.col("source_id"))).dropDuplicates(["ref"])


def failed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and code of every file that arrives and would end a run; its items up to there are not counted either."""
    return export.split_files(files(spark, folder)).where("run_error IS NOT NULL").select("path", F.col("run_error").alias("code"))


def counted(rows: DataFrame, take: Callable[[int, dict], None], seen: str) -> DataStreamWriter:
    """A writer that gives each micro-batch's twelve counters to ``take``. seen: a folder for the references, which lives
    as long as the query's checkpoint and in the same store."""

    def batch(part: DataFrame, number: int) -> None:
        spark = part.sparkSession
        refs = part.where("failure IS NULL").select(dedup.reference(F.col("source_id")).alias("ref"))
        earlier = spark.read.schema("ref string, batch long").parquet(seen).where(F.col("batch") < number) if number else None
        take(number, curate.summary(curate.classified(part, seen=earlier)).first().asDict())
        refs.distinct().write.mode("overwrite").parquet(f"{seen}/batch={number}")

    return rows.writeStream.foreachBatch(batch)
