"""Frames that the operators share: columns, row keys, shared storage."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Lets executors import this package, and keeps Arrow batches of long texts small. Both hold for the whole session:
    a longer PYTHONPATH for its Python workers, and at most 2,000 rows in its Arrow batches."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, 2001):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='skeinlake-')}")
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends, if not before."""
    path = f"{shared(spark)}/skeinlake/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


_PATHS: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are removed at the end. What leaves the block must be stored with ``outer``,
    or have been read to its end."""
    _PATHS.append([])
    try:
        yield
    finally:
        for path in _PATHS.pop():
            try:
                _remove(spark, path)
            except Exception as e:  # a table that stays costs disk, not results
                warnings.warn(f"{path} was not removed: {e}", stacklevel=2)


def stored(frame: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """The frame written to the shared folder and read back: cuts lineage and survives lost executors.
    outer: it belongs to the block around the innermost scratch()."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    scopes = _PATHS[:-1] if outer else _PATHS
    if scopes:
        scopes[-1].append(path)
    frame.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of what has been written
    return spark.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; other columns, of whatever name, can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
