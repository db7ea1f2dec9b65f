"""What a repository must not hold: private exports and reports, secrets, and marks that hide them.

Files come as rows (path, content), as Spark's binary or text readers give them; each is
judged in the task that has it, and lines are scanned by the same detectors as messages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redact
from ..sources import export

# Paths, names and endings that are never kept, texts that are scanned, and the mark of a suppression.
PREFIXES = (".private-test-data/", ".private-reports/", "dist/", "node_modules/")
NAMES = (".DS_Store", ".env", "conversation-report.json", "conversations.json", "report.json")
ENDINGS = (".log", ".report.json", ".tgz", ".tmp")
SCANNED = ("ts", "js", "json", "yml", "yaml", "md", "toml")
LOCK_FILE = "pnpm-lock.yaml"
MARKER = ":".join(("gitleaks", "allow"))


def forbidden(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    bad = name.isin(*NAMES) | F.startswith(name, F.lit(".env."))
    for x in PREFIXES:
        bad = bad | F.startswith(path, F.lit(x))
    for x in ENDINGS:
        bad = bad | F.endswith(name, F.lit(x))
    return bad


def is_private(value: object) -> bool:
    """Whether a JSON value is an export (an array with a conversation) or a report (one with a header and a summary)."""
    if not isinstance(value, list):
        return False
    kinds = [x.get("type") for x in value if isinstance(x, dict)]
    return any(map(export.is_conversation, value)) or ("header" in kinds and "summary" in kinds)


def resembling(files: DataFrame) -> DataFrame:
    """path and private of files; what isn't JSON is not private."""

    def judged(content: object) -> bool:
        try:
            return is_private(json.loads(content))
        except (TypeError, ValueError, RecursionError):
            return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "private": [judged(c) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, private boolean")


def violations(files: DataFrame, approved: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """path and rule (PATH, ARTIFACT, MARKER, SECRET), a row for each violation. approved: (path, line) whose mark is known.

    A file on a forbidden path isn't read further for artifacts; a line with a mark is judged for the mark alone, in any
    file; secrets are looked for in texts only."""
    spark = files.sparkSession
    own = files.select("path", F.col("content").cast("string").alias("content"))
    bad = own.where(forbidden(F.col("path"))).select("path", F.lit("PATH").alias("rule"))
    artifacts = resembling(own.where(~forbidden(F.col("path")) & F.endswith("path", F.lit(".json")))).where("private").select("path", F.lit("ARTIFACT").alias("rule"))
    lines = own.select("path", F.explode(F.split("content", r"\r?\n")).alias("line"))
    marked = lines.where(F.contains("line", F.lit(MARKER)))
    if approved:
        known = spark.createDataFrame(list(approved), "path string, line string")
        marked = marked.join(F.broadcast(known), ["path", "line"], "left_anti")  # a list from the caller's code
    ending = F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)
    texts = lines.where(~F.contains("line", F.lit(MARKER)) & ending.isin(*SCANNED) & (F.substring_index("path", "/", -1) != LOCK_FILE))
    secret = redact.scan(texts, "line").where(redact.hard() | redact.candidate()).select("path", F.lit("SECRET").alias("rule"))
    return bad.unionByName(artifacts).unionByName(marked.select("path", F.lit("MARKER").alias("rule"))).unionByName(secret)
