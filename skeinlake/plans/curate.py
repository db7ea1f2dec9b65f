"""The curation plan: canonical conversations to classified rows, failures, counters and events.

The text of messages is scanned in rows of its own, dealt out by Spark, and only
counts come back to the conversation; the classifier sees a bounded, redacted
sample. One shuffle by reference finds duplicates.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, redact
from ..functions import patterns as P
from ..operators import dedup, deep, segments

NOW = "1970-01-01T00:00:00.000Z"
KEY = ["path", "item_index"]


def classified(canonical: DataFrame, now: str = NOW, seen: DataFrame | None = None) -> DataFrame:
    """A row an item: path, item_index, failure, duplicate, and for the others reference, scan and result.
    seen: references (ref) that came before; an item with one of them is a duplicate."""
    parsed = canonical.where("failure IS NULL").withColumn("path", F.coalesce("path", F.lit(""))).withColumn("ref", dedup.reference(F.col("source_id")))
    broken = canonical.where("failure IS NOT NULL").select(F.coalesce("path", F.lit("")).alias("path"), "item_index", "failure")
    scans = segments.scans(parsed, KEY)
    light = parsed.drop("messages", "title", "source_id")
    # null-safe: a conversation table may have a row without an id
    s = scans.withColumnsRenamed({k: f"s_{k}" for k in KEY})
    joined = light.join(s, light["path"].eqNullSafe(s["s_path"]) & light["item_index"].eqNullSafe(s["s_item_index"])).drop(*[f"s_{k}" for k in KEY])
    marked = dedup.first_wins(joined, "ref", KEY)
    if seen is not None:
        before = seen.select("ref").distinct().withColumn("before", F.lit(True))
        marked = marked.join(before, "ref", "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("before", F.lit(False))).drop("before")
    fresh = marked.where(~F.col("duplicate"))
    again = marked.where("duplicate").select(*KEY, "duplicate", "ref", "hard", "candidate")
    text = F.array_join(F.concat(F.array("classification_title"), F.col("sampled")), "\n")
    seen = redact.sanitize(fresh.withColumn("context", text), "context").withColumn("context", F.lower(redact.context(F.col("sanitized")))).drop("sanitized", "findings")
    columns = _columns(id(canonical.sparkSession._jvm), now)
    chosen = seen.withColumn("selected", columns["selected"]).withColumn("status", columns["status"]).drop("context")
    done = _cleaned(chosen.withColumn("r", columns["result"]))
    names = done.schema["r"].dataType.names
    done = done.withColumn("fields", F.array(*[F.lit(n) for n in names])).withColumn("wrong", columns["wrong"]).drop("fields")
    failure = F.when(F.size("wrong") > 0, "CLASSIFICATION_INVALID").when(F.col("item_failure").isNotNull(), "OUTPUT_SANITIZATION_FAILED")
    done = done.withColumn("failure", failure).withColumn("detail", F.when(F.size("wrong") > 0, F.array_join("wrong", "；")).otherwise(F.col("item_failure"))).drop("wrong", "item_unsafe", "item_findings", "item_failure")
    return done.unionByName(again, allowMissingColumns=True).unionByName(broken, allowMissingColumns=True).withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


@lru_cache(8)
def _columns(session: int, now: str) -> dict[str, Column]:
    """The classifier's and the contract's expressions over the columns of classified(), built once a session."""
    c = F.col
    risks = F.array_compact(F.array(F.when(c("hard"), P.RISK_FLAGS[0]), F.when(c("candidate"), P.RISK_FLAGS[1])))
    required = F.concat(risks, F.array_compact(F.array(F.when(~c("current"), "BRANCH_FALLBACK"), F.when(~c("available"), "EMPTY_CONTENT"), F.when(c("truncated"), "CONTENT_TRUNCATED"))))
    level = redact.level(c("hard"), c("candidate"))
    found = lambda path: F.array_contains("item_unsafe", path)  # noqa: E731  paths of strings that had findings
    wrong = classify.errors(
        c("r"), fields=c("fields"), private_title=found(f"{OUTPUT}.suggestedTitle"),
        private_tags=F.transform("r.tags", lambda _, i: found(F.concat(F.lit(f"{OUTPUT}.tags["), i.cast("string"), F.lit("]")))),
        expected_id=c("ref"), minimum=level, expected_risks=risks, must_review=(level == "S3") | c("candidate") | ~c("current") | ~c("available") | c("truncated"), required=required,
    )
    result = classify.classification(c("ref"), c("selected"), c("status"), c("hard"), c("candidate"), c("current"), c("available"), c("truncated"), now)
    return {"selected": classify.selection(c("context")), "status": classify.lifecycle(c("context")), "result": result, "wrong": wrong}


def report_item() -> Column:
    """What is reported of a conversation; it holds no text of its own."""
    counts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(t).alias("key"), F.col(f"n_{t}").alias("value")) for t in P.SECRET_TYPES]), lambda e: e["value"] > 0))
    risks = F.col("r.riskFlags")
    security = F.struct(F.col("r.sensitivityLevel").alias("sensitivityLevel"), F.col("hard").alias("hardMatch"), F.col("candidate").alias("candidateMatch"), risks.alias("riskFlags"), counts.alias("matchCounts"))
    mode = F.when(F.col("current"), "current").otherwise("all-messages-fallback")
    return F.struct(F.col("ref").alias("conversationRef"), F.col("message_count").alias("messageCount"), mode.alias("branchMode"), F.col("truncated").alias("classificationTruncated"), security.alias("security"), F.col("r").alias("classification"))


OUTPUT = "output.classification"


def _cleaned(done: DataFrame) -> DataFrame:
    """done with item, what is reported, all of its strings sanitised; item_unsafe, the paths that had findings; and
    item_failure where the sanitised item or its JSON still shows one. Only what was rewritten is looked at twice."""
    clean = deep.sanitized(done.withColumn("item", report_item()), "item")
    return deep.assessed(clean, "item", F.col("item_findings") > 0)


COUNTERS = ("totalItems", "classified", "duplicates", "failed", "currentBranchParsed", "branchFallbacks", "contentUnavailable", "classificationTruncated", "s3", "s3Candidates", "suggestedAccept", "requiresReview")


def summary(rows: DataFrame) -> DataFrame:
    """The twelve counters, one row."""
    ok = F.col("failure").isNull() & ~F.col("duplicate")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    scanned = F.col("duplicate") | ok
    conditions = {
        "totalItems": F.lit(True), "classified": ok, "duplicates": F.col("duplicate"), "failed": F.col("failure").isNotNull(),
        "currentBranchParsed": ok & on("current") & on("available"), "branchFallbacks": ok & ~on("current"), "contentUnavailable": ok & ~on("available"), "classificationTruncated": ok & on("truncated"),
        "s3": scanned & on("hard"), "s3Candidates": scanned & on("candidate"), "suggestedAccept": ok & ~F.coalesce(F.col("r.requiresReview"), F.lit(True)), "requiresReview": ok & F.coalesce(F.col("r.requiresReview"), F.lit(True)),
    }
    return rows.agg(*[F.count_if(conditions[c]).alias(c) for c in COUNTERS])


def failure_text(code: Column) -> Column:
    out = F.lit(P.FAILURES["ITEM_PROCESSING_FAILED"])
    for k, v in P.FAILURES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def _checked(one: DataFrame, event: Column) -> DataFrame:
    """The one event's JSON; an unsafe one ends the run."""
    seen = deep.assessed(one.select(event.alias("output")), "output")
    said = F.concat(F.lit("OUTPUT_SANITIZATION_FAILED: "), F.col("output_failure"))
    return seen.select(F.when(F.col("output_failure").isNull(), F.to_json("output", {"ignoreNullFields": "false"})).otherwise(F.raise_error(said)).alias("json"))


def events(rows: DataFrame, source: Column, now: str = NOW) -> DataFrame:
    """section, item_index and json: a header, an event for each item that isn't a duplicate in file order, the summary.

    rows is used for the items and for the counters: hand over stored or persisted rows. Items are checked as they are
    classified, failures say fixed texts; header and summary are checked here."""
    spark = rows.sparkSession
    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    header = _checked(spark.range(1), F.struct(F.lit("header").alias("type"), F.lit(P.SCHEMA_VERSION).alias("schemaVersion"), F.lit(now).alias("generatedAt"), source.alias("source")))
    header = header.select(F.lit(0).alias("section"), F.lit(-1).cast("long").alias("item_index"), "json")
    conversation = as_json(F.struct(F.lit("conversation").alias("type"), F.col("item").alias("data")))
    failed = as_json(F.struct(F.lit("failure").alias("type"), F.struct(F.col("item_index").alias("itemIndex"), F.col("failure").alias("code"), failure_text(F.col("failure")).alias("message")).alias("data")))
    items = rows.where("NOT duplicate").select(F.lit(1).alias("section"), "item_index", F.when(F.col("failure").isNull(), conversation).otherwise(failed).alias("json"))
    privacy = F.struct(F.lit(False).alias("networkUsed"), F.lit(False).alias("rawMessageBodiesIncluded"), F.lit(False).alias("originalTitlesIncluded"), F.lit(False).alias("sensitiveValuesIncluded"), F.lit(True).alias("crossRunLinkable"))
    end = _checked(summary(rows), F.struct(F.lit("summary").alias("type"), F.struct(*COUNTERS).alias("summary"), privacy.alias("privacy")))
    end = end.select(F.lit(2).alias("section"), F.lit(-1).cast("long").alias("item_index"), "json")
    return header.unionByName(items).unionByName(end).orderBy("section", "item_index")


def source_token(sha256: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.array_join(F.regexp_extract_all(sha256, F.lit("(.{8})"), F.lit(1)), ":"))


def source_struct(sha256: str, size: int) -> Column:
    return F.struct(F.lit("chatgpt").alias("platform"), F.lit("conversations.json").alias("fileName"), source_token(F.lit(sha256)).alias("sha256"), F.lit(size).cast("long").alias("sizeBytes"))


def preview(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first conversations and failures by arrival."""
    fine = rows.where("failure IS NULL AND NOT duplicate").orderBy(*KEY).limit(P.PREVIEW_ITEMS).select("ref", F.col("r.requiresReview").alias("requiresReview"), F.col("r.suggestedTitle").alias("suggestedTitle"), F.col("r.sensitivityLevel").alias("sensitivityLevel"))
    failed = rows.where("failure IS NOT NULL").orderBy(*KEY).limit(P.PREVIEW_FAILURES).select("item_index", "failure", failure_text(F.col("failure")).alias("message"))
    return fine, failed


GATES = (
    ("PRIVATE_SAMPLE_NO_CLASSIFIED_ITEMS", "totalItems = 0 OR classified = 0"),
    ("PRIVATE_SAMPLE_PARTIAL_FAILURE", "failed > 0"),
    ("PRIVATE_SAMPLE_DUPLICATE_IDS", "duplicates > 0"),
    ("PRIVATE_SAMPLE_STRUCTURE_UNVERIFIED", "currentBranchParsed = 0 OR branchFallbacks > 0 OR contentUnavailable > 0 OR classificationTruncated > 0"),
    ("PRIVATE_SAMPLE_NOT_DEIDENTIFIED", "s3 > 0 OR s3Candidates > 0"),
)


def gate(summary: DataFrame) -> DataFrame:
    """summary with the code of the first compatibility gate that blocks, or null."""
    code = F.lit(None).cast("string")
    for name, condition in reversed(GATES):
        code = F.when(F.expr(condition), name).otherwise(code)
    return summary.withColumn("gate", code)
