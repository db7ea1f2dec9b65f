"""One run over an export file: snapshot, items, plan, report.

A run has a folder of its own, below ``root`` or the folder of spark.checkpoint.dir, which
executors share; only where neither is set it is a temporary folder, for local runs. It
holds the snapshot, and items and classified rows as Parquet, so that nothing is worked
out twice and a lost executor loses nothing. It goes when the report is closed; folders
that a killed driver left go when the next run begins.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P
from ..sources import export
from ..sources.export import InputError
from . import curate


FOLDER = "skeinlake-run-"


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except OSError:
        pass
    return True


def sweep(root: str) -> None:
    """Removes the folders of runs whose driver has gone."""
    for name in os.listdir(root):
        pid = name.removeprefix(FOLDER).split("-")[0]
        if name.startswith(FOLDER) and pid.isdigit() and not alive(int(pid)):
            shutil.rmtree(f"{root}/{name}", ignore_errors=True)


def shared_root(spark: SparkSession) -> str:
    """A folder that driver and executors see, as a path: that of spark.checkpoint.dir, or a local one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        return tempfile.gettempdir()
    if "://" in root and not root.startswith("file://"):
        raise InputError("INPUT_SNAPSHOT_FAILED", "the shared folder has to be mounted: an export's snapshot is a private file")
    path = root.removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


@dataclass
class Snapshot:
    path: str
    size: int
    sha256: str

    def remove(self) -> None:
        try:
            shutil.rmtree(Path(self.path).parent)
        except FileNotFoundError:
            pass
        except OSError:
            raise InputError("INPUT_SNAPSHOT_CLEANUP_FAILED") from None


def snapshot(path: str, root: str | None = None) -> Snapshot:
    """A private copy of a regular .json file that didn't change while it was copied. root: a folder that executors share."""
    if Path(path).suffix.lower() != ".json":
        raise InputError("INVALID_FILE_TYPE")
    try:
        source = os.open(path, os.O_RDONLY | os.O_NONBLOCK)
    except OSError:
        raise InputError("INPUT_NOT_READABLE") from None
    folder = None
    try:
        before = os.fstat(source)
        if not stat.S_ISREG(before.st_mode):
            raise InputError("INPUT_NOT_FILE")
        if not before.st_size:
            raise InputError("INPUT_EMPTY")
        if before.st_size > P.MAX_INPUT_BYTES:
            raise InputError("INPUT_TOO_LARGE")
        folder = tempfile.mkdtemp(prefix=f"{FOLDER}{os.getpid()}-", dir=root)
        target, digest, size = f"{folder}/snapshot.json", hashlib.sha256(), 0
        with open(os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "wb") as out:
            while part := os.read(source, 1 << 20):
                size += len(part)
                if size > P.MAX_INPUT_BYTES:
                    raise InputError("INPUT_TOO_LARGE")
                digest.update(part)
                out.write(part)
            out.flush()
            os.fsync(out.fileno())
        same = lambda s: (s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns)
        if same(before) != same(os.fstat(source)) or size != before.st_size:
            raise InputError("SOURCE_CHANGED_DURING_SNAPSHOT")
        return Snapshot(target, size, digest.hexdigest())
    except BaseException:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
        raise
    finally:
        os.close(source)


@dataclass
class Report:
    """events can be read until close(), which removes what the run stored."""

    events: DataFrame
    summary: dict[str, int]
    conversations: list
    failures: list
    close: Callable[[], None] = field(default=lambda: None)


def stamp(now: datetime | None) -> str:
    at = (now or datetime.now(UTC)).astimezone(UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def rows_of(spark: SparkSession, path: str, now: str, folder: str) -> DataFrame:
    """Classified rows of the export files at path, stored in the folder; InputError with the first file's error that ends a run."""
    export.items(spark, path).write.parquet(f"{folder}/items")
    items = spark.read.schema(export.ITEMS).parquet(f"{folder}/items")
    error = items.where("run_error IS NOT NULL").orderBy("path").select("run_error").first()
    if error:
        raise InputError(error[0])
    # a file is split by one task; deal its items out before they are parsed and scanned
    rows = curate.classified(export.canonicalized(items.repartition("path", "item_index")), now)
    rows.write.parquet(f"{folder}/rows")
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def curate_file(spark: SparkSession, path: str, now: datetime | None = None, root: str | None = None, on_event: Callable[[str], None] | None = None) -> Report:
    """Runs over one file. on_event gets every event's JSON in order; what it raises ends the run, and an interrupt
    also its Spark jobs."""
    root = root or shared_root(spark)
    sweep(root)
    copy = snapshot(path, root)
    tag = f"skeinlake-{uuid.uuid4().hex}"
    spark.addTag(tag)
    try:
        at = stamp(now)
        rows = rows_of(spark, f"file://{copy.path}", at, f"file://{Path(copy.path).parent}")
        counters = curate.summary(rows).first().asDict()
        out = curate.events(rows, curate.source_struct(copy.sha256, copy.size), at)
        if on_event:
            for r in out.toLocalIterator():  # one ordered file, written a row at a time
                on_event(r.json)
        fine, failed = curate.preview(rows)
        return Report(out, counters, fine.collect(), failed.collect(), copy.remove)  # at most 20 and 10 rows
    except BaseException as e:
        if not isinstance(e, Exception):
            spark.interruptTag(tag)
        copy.remove()
        raise
    finally:
        spark.removeTag(tag)


def check_compatibility(spark: SparkSession, path: str) -> str | None:
    """None if a private sample passes every gate, else the code of the first that it doesn't pass."""
    if not os.path.exists(path):
        return "PRIVATE_SAMPLE_MISSING"
    report = curate_file(spark, path)
    report.close()
    counters = report.summary
    return curate.gate(spark.createDataFrame([counters])).select("gate").first()[0]


