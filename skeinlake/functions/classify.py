"""Keyword and cue classification, and the contract that its results must meet, in columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .redact import let


def keyword_found(text: Column, keyword: str) -> Column:
    """An ASCII keyword as a word of its own, any other as a substring; text is in lower case."""
    if keyword.isascii() and all(c.isalnum() or c in "_-" for c in keyword):
        return F.contains(text, F.lit(keyword)) & F.rlike(text, F.lit(rf"(?<![a-z0-9_]){keyword}(?![a-z0-9_])"))
    return F.contains(text, F.lit(keyword))


def score(text: Column, category: P.Category) -> Column:
    """Number of the category's keywords that the text holds."""
    return sum((keyword_found(text, k).cast("int") for k in category.keywords), F.lit(0))


def selection(text: Column) -> Column:
    """struct(ordinal, score, tied): the first category of the highest score; the last of the taxonomy if all are 0."""
    scores = F.array(*[F.struct(score(text, c).alias("score"), F.lit(-i).alias("rank")) for i, c in enumerate(P.TAXONOMY[:-1])])

    def chosen(s: Column) -> Column:
        best = F.array_max(s)
        none = best["score"] == 0
        tied = F.size(F.filter(s, lambda x: x["score"] == best["score"])) > 1
        return F.struct(F.when(none, len(P.TAXONOMY) - 1).otherwise(-best["rank"]).alias("ordinal"), best["score"].alias("score"), (~none & tied).alias("tied"))

    return let(scores, chosen)


def _cue(text: Column, status: str, pattern: str) -> Column:
    """Whether the pattern stands in the text. It looks around at every character, so the words in it are sought first."""
    word = lambda h: F.rlike(text, F.lit(f"(?i){h}")) if h.isascii() else F.contains(text, F.lit(h))
    held = reduce(or_, map(word, P.CUE_WORDS[status])) | F.rlike(text, F.lit(P.FOLDED_TO_ASCII))
    return held & F.rlike(text, F.lit(pattern))


def lifecycle(text: Column) -> Column:
    """The one status whose cue stands in the text; active if there is none, several or a negation."""
    cues = F.array(*[_cue(text, name, p) for name, p in P.CUES])

    def status(found: Column) -> Column:
        one = F.size(F.filter(found, lambda x: x)) == 1
        named = F.element_at(F.array(*[F.lit(name) for name, _ in P.CUES]), F.array_position(found, True).cast("int"))
        return F.when(F.when(one, ~F.rlike(text, F.lit(P.NEGATION))).otherwise(False), named).otherwise("active")

    return let(cues, status)


def confidence(score: Column, tied: Column) -> Column:
    return F.when(score == 0, P.NO_KEYWORD).when(tied, P.TIED).when(score == 1, P.ONE_KEYWORD).otherwise(P.MORE_KEYWORDS)


def _of(ordinal: Column, values: Iterable[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ordinal + 1)


def _if(*pairs: tuple[Column, str]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def title(ordinal: Column, status: Column) -> Column:
    return F.concat(F.lit("["), _of(ordinal, (c.label for c in P.TAXONOMY)), F.lit("] 整理"), _of(ordinal, (c.object for c in P.TAXONOMY)), F.lit(" · "), status_label(status))


def status_label(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in P.STATUS_LABELS.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def classification(ref: Column, selected: Column, status: Column, hard: Column, candidate: Column, current: Column, available: Column, truncated: Column, now: str) -> Column:
    """The result of a conversation, a struct of 18 fields."""
    return let(F.struct(selected.alias("s"), status.alias("status")), lambda v: _result(ref, v["s"], v["status"], hard, candidate, current, available, truncated, now))


def _result(ref: Column, selected: Column, status: Column, hard: Column, candidate: Column, current: Column, available: Column, truncated: Column, now: str) -> Column:
    o, sure = selected["ordinal"], confidence(selected["score"], selected["tied"])
    settled = F.when(status == "active", P.ACTIVE).otherwise(P.EXPLICIT)
    low = (sure < P.REVIEW_BELOW) | (settled < P.REVIEW_BELOW)
    level = F.when(hard, "S3").when(candidate, "S2").otherwise("S0")
    risks = ((hard, P.RISK_FLAGS[0]), (candidate, P.RISK_FLAGS[1]))
    category = _of(o, (c.id for c in P.TAXONOMY))
    return F.struct(
        ref.alias("conversationId"), F.lit(P.TAXONOMY_VERSION).alias("taxonomyVersion"), category.alias("primaryCategoryId"), F.lit(None).cast("string").alias("projectId"),
        _of(o, (c.intent for c in P.TAXONOMY)).alias("intent"), _of(o, (c.deliverable for c in P.TAXONOMY)).alias("deliverableType"), status.alias("lifecycleStatus"),
        _of(o, (c.value for c in P.TAXONOMY)).alias("valueLevel"), level.alias("sensitivityLevel"), title(o, status).alias("suggestedTitle"), F.array(category, status).alias("tags"),
        F.struct(sure.alias("primaryCategoryId"), settled.alias("lifecycleStatus"), sure.alias("suggestedTitle")).alias("fieldConfidence"),
        _if(*risks).alias("riskFlags"),
        _if((F.lit(True), "UNKNOWN_PROJECT"), (low, "LOW_CONFIDENCE"), (selected["tied"], "MULTI_TOPIC"), *risks, (~current, "BRANCH_FALLBACK"), (~available, "EMPTY_CONTENT"), (truncated, "CONTENT_TRUNCATED")).alias("reasonCodes"),
        (low | (level != "S0") | ~current | ~available | truncated).alias("requiresReview"),
        F.lit(P.PROVIDER).alias("classifierProvider"), F.lit(P.TAXONOMY_VERSION).alias("classifierVersion"), F.lit(now).alias("createdAt"),
    )


FIELDS = ("conversationId", "taxonomyVersion", "primaryCategoryId", "projectId", "intent", "deliverableType", "lifecycleStatus", "valueLevel", "sensitivityLevel", "suggestedTitle", "tags", "fieldConfidence", "riskFlags", "reasonCodes", "requiresReview", "classifierProvider", "classifierVersion", "createdAt")


def field_errors(fields: Column) -> Column:
    """Errors in an array of field names; unknown names are counted, not told."""
    known = F.array(*[F.lit(f) for f in FIELDS])
    unknown, missing = F.size(F.array_except(fields, known)), F.array_except(known, fields)
    return F.array_compact(F.array(F.when(unknown > 0, F.concat(F.lit("包含 "), unknown.cast("string"), F.lit(" 个未知字段"))), F.when(F.size(missing) > 0, F.concat(F.lit("缺少字段："), F.array_join(missing, "、")))))


def errors(r: Column, **how) -> Column:
    """What is wrong with a result, in the order of the contract; valid if empty. See _errors."""
    return let(r, lambda x: _errors(x, **how))


def _errors(r: Column, fields: Column | None = None, private_title: Column | None = None, private_tags: Column | None = None, expected_id: Column | None = None, minimum: Column | None = None, expected_risks: Column | None = None, must_review: Column | None = None, required: Column | None = None) -> Column:
    """fields: the result's field names, if they have to be checked. private_title: whether the detectors find something
    in the title; private_tags: the same for each tag, an array."""
    private_title, must_review = (F.lit(False) if c is None else c for c in (private_title, must_review))
    private_tags = F.array().cast("array<boolean>") if private_tags is None else private_tags
    no = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  a null comparison isn't true
    among = lambda c, names: no(c.isin(*names))
    all_among = lambda a, names: no(F.forall(a, lambda x: x.isin(*names)))
    ids = [c.id for c in P.TAXONOMY if not c.deprecated]
    o = F.array_position(F.array(*[F.lit(c.id) for c in P.TAXONOMY]), r["primaryCategoryId"]).cast("int") - 1
    known = no(o >= 0)
    at = F.greatest(F.coalesce(o, F.lit(0)), F.lit(0))
    equal = lambda c, values: no(c == _of(at, values))
    t, status, tags = r["suggestedTitle"], r["lifecycleStatus"], r["tags"]
    status_known = among(status, P.STATUS_LABELS)
    conf = F.array(*[r["fieldConfidence"][c] for c in P.CONFIDENCES])
    conf_ok = no(F.forall(conf, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)))
    low = conf_ok & F.exists(conf, lambda x: x < P.REVIEW_BELOW)
    listed = lambda a, names: no((F.size(a) >= 0) & (F.size(a) <= 16) & (F.size(F.array_distinct(a)) == F.size(a))) & all_among(a, names)
    risks_ok, reasons_ok = listed(r["riskFlags"], P.RISK_FLAGS), listed(r["reasonCodes"], P.REASONS)
    has = lambda a, x: no(F.array_contains(a, x))
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in P.LEVELS]), c)
    review = must_review | no(r["sensitivityLevel"] != "S0") | has(r["riskFlags"], "S3_CANDIDATE") | low
    for code in ("LOW_CONFIDENCE", "BRANCH_FALLBACK", "EMPTY_CONTENT", "CONTENT_TRUNCATED"):
        review = review | has(r["reasonCodes"], code)
    titled = no(t != "")
    checks = [
        (~no(F.rlike(r["conversationId"], F.lit(r"^conv:(?:[a-f0-9]{8}:){7}[a-f0-9]{8}\z"))), "conversationId 必须是本地安全引用"),
        (~no(r["conversationId"] == expected_id) if expected_id is not None else F.lit(False), "conversationId 与当前分类请求不一致"),
        (~no(r["taxonomyVersion"] == P.TAXONOMY_VERSION), "taxonomyVersion 无效"),
        (~among(r["primaryCategoryId"], ids), "primaryCategoryId 不存在或已废弃"),
        (r["projectId"].isNotNull(), "projectId 必须为 null"),
        (~no(r["intent"] != ""), "intent 无效"), (~no(r["deliverableType"] != ""), "deliverableType 无效"),
        (known & ~equal(r["intent"], [c.intent for c in P.TAXONOMY]), "intent 与 taxonomy 不一致"),
        (known & ~equal(r["deliverableType"], [c.deliverable for c in P.TAXONOMY]), "deliverableType 与 taxonomy 不一致"),
        (known & ~equal(r["valueLevel"], [c.value for c in P.TAXONOMY]), "valueLevel 与 taxonomy 不一致"),
        (~status_known, "lifecycleStatus 无效"), (~among(r["valueLevel"], P.VALUES), "valueLevel 无效"), (~among(r["sensitivityLevel"], P.LEVELS), "sensitivityLevel 无效"),
        (among(r["sensitivityLevel"], P.LEVELS) & no(rank(r["sensitivityLevel"]) < rank(minimum)) if minimum is not None else F.lit(False), "sensitivityLevel 低于确定性扫描结果"),
        (~titled, "suggestedTitle 无效"),
        (titled & ~F.length(t).between(16, 30), "suggestedTitle 长度必须为 16–30 个字符"),
        (titled & ~no(F.rlike(t, F.lit(r"^\[[^\]\r\n]{2,12}\] .+ · (?:" + "|".join(P.STATUS_LABELS.values()) + r")\z"))), "suggestedTitle 格式或状态无效"),
        (titled & private_title, "suggestedTitle 含敏感信息"),
        (titled & known & status_known & ~no(t == title(at, status)), "suggestedTitle 与 taxonomy 或 lifecycleStatus 不一致"),
        (tags.isNull() | no(F.exists(tags, lambda x: x.isNull())), "tags 无效"),
        (no(F.size(tags) > 8), "tags 数量超过 8"),
    ]
    tagged = no(F.size(tags) >= 0) & ~no(F.exists(tags, lambda x: x.isNull()))
    named = lambda i, what: F.concat(F.lit("tags["), i.cast("string"), F.lit(f"] {what}"))
    by_tag = lambda x, i: F.array(F.when(~F.length(x).between(1, 32), named(i, "长度无效")), F.when(no(F.get(private_tags, i)), named(i, "含敏感信息")))
    of_tags = F.when(tagged, F.array_compact(F.flatten(F.transform(tags, by_tag)))).otherwise(F.array().cast("array<string>"))
    after = [
        (tags.isNotNull() & known & status_known & ~no(tags == F.array(r["primaryCategoryId"], status)), "tags 与 taxonomy 或 lifecycleStatus 不一致"),
        (~conf_ok, "fieldConfidence 无效"), (~risks_ok, "riskFlags 无效"),
        (risks_ok & ~no(F.array_sort(r["riskFlags"]) == F.array_sort(expected_risks)) if expected_risks is not None else F.lit(False), "riskFlags 与确定性扫描结果不一致"),
        (~reasons_ok, "reasonCodes 无效"),
        (reasons_ok & ((has(r["reasonCodes"], P.RISK_FLAGS[0]) != has(r["riskFlags"], P.RISK_FLAGS[0])) | (has(r["reasonCodes"], P.RISK_FLAGS[1]) != has(r["riskFlags"], P.RISK_FLAGS[1]))), "reasonCodes 与 riskFlags 不一致"),
        (reasons_ok & no(F.size(F.array_except(required, r["reasonCodes"])) > 0) if required is not None else F.lit(False), "reasonCodes 缺少强制复核原因"),
        (reasons_ok & (has(r["reasonCodes"], "LOW_CONFIDENCE") != low), "reasonCodes 与 fieldConfidence 不一致"),
        (reasons_ok & ~has(r["reasonCodes"], "UNKNOWN_PROJECT"), "reasonCodes 缺少 UNKNOWN_PROJECT"),
        (r["requiresReview"].isNull(), "requiresReview 无效"), (review & ~F.coalesce(r["requiresReview"], F.lit(True)), "requiresReview 违反强制复核规则"),
        (~no(r["classifierProvider"] == P.PROVIDER), "classifierProvider 无效"), (~no(r["classifierVersion"] == P.TAXONOMY_VERSION), "classifierVersion 无效"),
        (~no(F.rlike(r["createdAt"], F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\z")) & F.try_to_timestamp(r["createdAt"]).isNotNull()), "createdAt 无效"),
    ]
    named_fields = F.array().cast("array<string>") if fields is None else field_errors(fields)
    return F.concat(named_fields, _if(*checks), of_tags, _if(*after))
