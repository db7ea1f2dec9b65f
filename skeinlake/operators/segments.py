"""Secret scans of conversations: the stronger of two views of each message, summed over messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import redact

COUNTS = [f"n_{t}" for t in P.SECRET_TYPES]


def scans(conversations: DataFrame, key: list[str]) -> DataFrame:
    """key, n_<TYPE>, hard and candidate. A message is scanned joined and, if it has parts, part by part; of the
    two counts of a rule the larger holds, and messages and the title add up."""
    title = F.struct(F.col("title").alias("text"), F.array().cast("array<string>").alias("parts"))
    messages = conversations.select(*key, F.posexplode(F.concat(F.array(title), F.col("messages"))).alias("message", "m"))
    views = F.concat(F.array(F.struct(F.lit(0).alias("view"), F.col("m.text").alias("text"))), F.transform("m.parts", lambda p: F.struct(F.lit(1).alias("view"), p.alias("text"))))
    texts = messages.select(*key, "message", F.explode(views).alias("v")).select(*key, "message", "v.view", "v.text")
    found = redact.scan(texts, "text")
    by_view = found.groupBy(*key, "message", "view").agg(*[F.sum(c).alias(c) for c in COUNTS])
    by_message = by_view.groupBy(*key, "message").agg(*[F.max(c).alias(c) for c in COUNTS])
    total = by_message.groupBy(*key).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    return total.withColumn("hard", redact.hard()).withColumn("candidate", redact.candidate())
