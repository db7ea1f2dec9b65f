"""Conversation tables (conv_id, turn, role, text) in the form that exports are brought to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{P.SPACE}]+|[{P.SPACE}]+$", "")


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def _cut(c: Column, first: bool) -> Column:
    """The first or last half of the limit in UTF-16 units; half of a character at the cut becomes U+FFFD."""
    size = P.MAX_CHARACTERS  # bytes in half of the units
    b = F.encode(c, "UTF-16LE")
    part = F.substring(b, 1, size) if first else F.substr(b, F.octet_length(b) - size + 1, F.lit(size))
    edge = F.hex(F.substring(part, size if first else 2, 1))  # the high byte of the unit at the cut
    whole = F.substring(part, 1, size - 2) if first else F.substring(part, 3, size - 2)
    torn = edge.between("D8", "DB") if first else edge.between("DC", "DF")
    text = F.decode(F.when(torn, whole).otherwise(part), "UTF-16LE")
    odd = F.when(torn, "\ufffd").otherwise("")
    return F.concat(text, odd) if first else F.concat(odd, text)


def head_tail(c: Column) -> Column:
    """The text, or its first and last half of the limit, in UTF-16 units."""
    half = P.MAX_CHARACTERS // 2
    plain = F.length(c) == units(c)
    first, last = F.when(plain, F.substring(c, 1, half)).otherwise(_cut(c, True)), F.when(plain, F.right(c, F.lit(half))).otherwise(_cut(c, False))
    return F.when(units(c) > P.MAX_CHARACTERS, F.concat(first, F.lit("\n[CONTENT_TRUNCATED]\n"), last)).otherwise(c)


def sampled(shown: Column) -> Column:
    """All of up to six texts, else the first and last three."""
    return F.when(F.size(shown) <= 6, shown).otherwise(F.concat(F.slice(shown, 1, 3), F.slice(shown, -3, 3)))


def conversations(turns: DataFrame) -> DataFrame:
    """Each conv_id as one conversation on its current branch, in order of turn, without a title; item_index is its rank by id.

    The canonical columns are those of exports; a message without text is none. Turns are dealt out by a set number of
    partitions, which Spark keeps: the scans that follow cost more than their bytes tell."""
    turns = turns.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    t = turns.select("conv_id", "turn", "role", trim(F.coalesce("text", F.lit(""))).alias("text")).where("text != ''")
    shown = F.when(F.col("role").isNull() | F.col("role").isin("user", "assistant"), F.col("text")).otherwise("")
    grouped = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", shown.alias("shown")))).alias("m"))
    every = turns.select("conv_id").distinct().join(grouped, "conv_id", "left")
    m = F.coalesce("m", F.array().cast("array<struct<turn:bigint,role:string,text:string,shown:string>>"))
    every = every.withColumn("m", m).withColumn("shown", F.filter(F.transform("m", lambda x: x["shown"]), lambda x: x != ""))
    picked = sampled(F.col("shown"))
    return every.select(
        F.lit(None).cast("string").alias("path"), F.col("conv_id").cast("long").alias("item_index"), F.lit(None).cast("string").alias("failure"),
        F.col("conv_id").cast("string").alias("source_id"), F.lit(P.UNTITLED).alias("title"), F.lit(P.UNTITLED).alias("classification_title"),
        F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("updated_at"), F.size("m").cast("long").alias("message_count"),
        (F.size("shown") > 0).alias("available"), F.exists(picked, lambda x: units(x) > P.MAX_CHARACTERS).alias("truncated"), F.lit(True).alias("current"),
        F.transform(picked, head_tail).alias("sampled"), F.transform("m", lambda x: F.struct(x["text"].alias("text"), F.array().cast("array<string>").alias("parts"))).alias("messages"),
    )
