"""Registered queries over the reference's operators, each with SQL that gives the same rows.

Fixtures are SQL text that both engines read; they hold no backslash, and
secret-like strings are put together when they run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, redact
from ..functions import patterns as P
from ..operators import dedup, deep, segments
from ..sources import export, tables
from . import curate, policy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = "[" + "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)) + "]"
#: The turns of the conversations table as messages: trimmed, without the empty ones, numbered.
MESSAGES_SQL = f"""
m AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), {_q(f"^{WS}+")}, ''), {_q(f"{WS}+$")}, '') AS text FROM conversations),
v AS (SELECT conv_id, turn, text, role IS NULL OR role IN ('user', 'assistant') AS visible FROM m WHERE text <> ''),
s AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS j,
        count(*) OVER (PARTITION BY conv_id) AS n FROM v WHERE visible)"""


@query(f"""
WITH {MESSAGES_SQL}
SELECT c.conv_id, count(v.turn) AS n_messages, count(*) FILTER (WHERE v.visible) AS n_visible, coalesce(bool_or(v.visible), false) AS available
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN v ON c.conv_id = v.conv_id GROUP BY c.conv_id""")
def conv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.conversations(tables.table(spark, sf_dir, "conversations"))
    turns = tables.table(spark, sf_dir, "conversations").where(tables.trim(F.col("text")) != "")
    visible = turns.where("role IS NULL OR role IN ('user', 'assistant')").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.join(visible, c["item_index"] == visible["conv_id"], "left").select(c["item_index"].alias("conv_id"), F.col("message_count").alias("n_messages"), F.coalesce("n", F.lit(0)).alias("n_visible"), "available")


@query(f"""
WITH {MESSAGES_SQL}
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS pos,
  sha256(CASE WHEN length(text) > 32768 THEN left(text, 16384) || chr(10) || '[CONTENT_TRUNCATED]' || chr(10) || right(text, 16384) ELSE text END) AS sha
FROM s WHERE n <= 6 OR i <= 3 OR j <= 3""")
def conv_head_tail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.conversations(tables.table(spark, sf_dir, "conversations"))
    return c.select(F.col("item_index").alias("conv_id"), F.posexplode("sampled")).select("conv_id", (F.col("pos") + 1).cast("long").alias("pos"), F.sha2("col", 256).alias("sha"))


GROUPED = "substr(h, 1, 8) || ':' || substr(h, 9, 8) || ':' || substr(h, 17, 8) || ':' || substr(h, 25, 8) || ':' || substr(h, 33, 8) || ':' || substr(h, 41, 8) || ':' || substr(h, 49, 8) || ':' || substr(h, 57, 8)"


@query(f"SELECT conv_id, 'conv:' || {GROUPED} AS ref FROM (SELECT DISTINCT conv_id, sha256('chatgpt:' || conv_id::VARCHAR) AS h FROM conversations)")
def conv_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tables.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", dedup.reference(F.col("conv_id").cast("string")).alias("ref"))


def _keyword_sql(text: str, k: str) -> str:
    if k.isascii():
        return f"regexp_matches({text}, '(^|[^a-z0-9_]){k}([^a-z0-9_]|$)')::INT"
    return f"contains({text}, '{k}')::INT"


def _scores_sql(text: str) -> str:
    return ", ".join("(" + " + ".join(_keyword_sql(text, k) for k in c.keywords) + f') AS "s{i}"' for i, c in enumerate(P.TAXONOMY[:-1]))


SPACES = "[" + "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x3000, 0xFEFF)) + "]"
NEGATION_SQL = f"(?i)(^|[^a-z0-9_])(unresolved|unfinished|incomplete|not{SPACES}+((yet|fully){SPACES}+)?(resolved|finished|done|completed)|never{SPACES}+(resolved|finished|done|completed))([^a-z0-9_]|$)|(未|没|尚未|没有)(全部|完全)?(完成|解决)"
CUES_SQL = {
    "completed": "(?i)已完成|完成了|已解决|(^|[^a-z0-9_])(resolved|finished|done|completed)([^a-z0-9_]|$)",
    "pending": "(?i)等待|待办|稍后|(^|[^a-z0-9_])(pending|todo)([^a-z0-9_]|$)",
    "archived": "(?i)归档|不再处理|(^|[^a-z0-9_])archived([^a-z0-9_]|$)",
}


def _classified_sql(source: str) -> str:
    """CTEs that classify source(id, text): k has scores and cues, g the choice."""
    cues = ", ".join(f"regexp_matches(text, {_q(p)}) AS {name}" for name, p in CUES_SQL.items())
    best = "greatest(s0, s1, s2, s3, s4)"
    return f"""
k AS (SELECT id, text, {_scores_sql('text')}, regexp_matches(text, {_q(NEGATION_SQL)}) AS negated, {cues} FROM (SELECT id, lower(text) AS text FROM {source})),
g AS (SELECT *, {best} AS score, {best} > 0 AND (s0 = {best})::INT + (s1 = {best})::INT + (s2 = {best})::INT + (s3 = {best})::INT + (s4 = {best})::INT > 1 AS tied,
  CASE WHEN {best} = 0 THEN 'other' {' '.join(f"WHEN s{i} = {best} THEN '{c.id}'" for i, c in enumerate(P.TAXONOMY[:-1]))} END AS category,
  CASE WHEN negated OR completed::INT + pending::INT + archived::INT <> 1 THEN 'active' WHEN completed THEN 'completed' WHEN pending THEN 'pending' ELSE 'archived' END AS status FROM k)"""


TEXTS = """SELECT * FROM (VALUES
  (1, 'anode catalog'), (2, 'node api'), (3, '开发 TypeScript 测试已完成'), (4, 'roadmap and email'), (5, 'not yet completed bug api'),
  (6, 'resolved python code 代码'), (7, 'pending todo'), (8, 'archived recipe travel'), (9, 'done pending'), (10, ''), (11, '没有完成 论文 研究'), (12, '等待 论文 研究 分析'),
  (13, 'unfinishedx finished draft email'), (14, 'MVP 需求 ROADMAP'), (15, 'api_key bug-fix node.js'), (16, '生活 旅行 完成了'), (17, 'never done'), (18, 'learn é research'), (19, 'nothing here'), (20, '总结 翻译 稍后')
) AS t(id, text)"""


def _texts(spark: SparkSession) -> DataFrame:
    return spark.sql(TEXTS).select(F.col("id").cast("long").alias("id"), F.lower("text").alias("text"))


@query(f"WITH f AS ({TEXTS}), {_classified_sql('f')} SELECT id::BIGINT AS id, c AS category, sc::BIGINT AS score FROM (" + " UNION ALL ".join(f"SELECT id, '{c.id}' AS c, s{i} AS sc FROM g" for i, c in enumerate(P.TAXONOMY[:-1])) + ")")
def fx_keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(*[F.struct(F.lit(c.id).alias("category"), classify.score(F.col("text"), c).cast("long").alias("score")) for c in P.TAXONOMY[:-1]])
    return _texts(spark).select("id", F.inline(scores))


@query(f"WITH f AS ({TEXTS}), {_classified_sql('f')} SELECT id::BIGINT AS id, status FROM g")
def fx_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", classify.lifecycle(F.col("text")).alias("status"))


_RESULT_SQL = """
SELECT id::BIGINT AS id, category, status, score::BIGINT AS score, tied,
  CASE WHEN score = 0 THEN 0.3::DOUBLE WHEN tied THEN 0.5::DOUBLE WHEN score = 1 THEN 0.68::DOUBLE ELSE 0.84::DOUBLE END AS confidence,
  NOT (score >= 2 AND NOT tied AND status <> 'active') AS review
FROM g"""


@query(f"WITH f AS ({TEXTS}), {_classified_sql('f')} {_RESULT_SQL}")
def fx_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    no, yes = F.lit(False), F.lit(True)
    r = classify.classification(F.lit("x"), F.col("s"), F.col("status"), no, no, yes, yes, no, curate.NOW)
    d = _texts(spark).withColumn("s", classify.selection(F.col("text"))).withColumn("status", classify.lifecycle(F.col("text"))).withColumn("r", r)
    return d.select("id", F.col("r.primaryCategoryId").alias("category"), F.col("r.lifecycleStatus").alias("status"), F.col("s.score").cast("long").alias("score"), "s.tied", F.col("r.fieldConfidence.primaryCategoryId").alias("confidence"), F.col("r.requiresReview").alias("review"))


@query(f"WITH f AS ({TEXTS}), {_classified_sql('f')} SELECT category, status, count(*) AS n FROM g GROUP BY CUBE (category, status)")
def fx_category_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c.id) for c in P.TAXONOMY])
    d = _texts(spark).select(F.element_at(names, classify.selection(F.col("text"))["ordinal"] + 1).alias("category"), classify.lifecycle(F.col("text")).alias("status"))
    return d.cube("category", "status").agg(F.count("*").alias("n"))


FLAGS = "SELECT * FROM (VALUES (0, false), (1, true)) AS {0}(x{0}, {0})"
_FLAG_JOIN = " CROSS JOIN ".join(f"({FLAGS.format(c)}) {c}_" for c in ("hard", "candidate", "fallback", "empty", "truncated"))


@query(f"""
WITH f AS ({TEXTS}), {_classified_sql('f')}
SELECT g.id::BIGINT AS id, hard, candidate, fallback, empty, truncated,
  NOT (score >= 2 AND NOT tied AND status <> 'active') OR hard OR candidate OR fallback OR empty OR truncated AS review,
  array_to_string(list_filter(['UNKNOWN_PROJECT', CASE WHEN NOT (score >= 2 AND NOT tied AND status <> 'active') THEN 'LOW_CONFIDENCE' END, CASE WHEN tied THEN 'MULTI_TOPIC' END,
    CASE WHEN hard THEN 'SENSITIVE_PATTERN' END, CASE WHEN candidate THEN 'S3_CANDIDATE' END, CASE WHEN fallback THEN 'BRANCH_FALLBACK' END, CASE WHEN empty THEN 'EMPTY_CONTENT' END, CASE WHEN truncated THEN 'CONTENT_TRUNCATED' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN hard THEN 'S3' WHEN candidate THEN 'S2' ELSE 'S0' END AS level, 0::BIGINT AS n_errors
FROM g CROSS JOIN {_FLAG_JOIN}""")
def fx_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with every combination of flags: review, reasons, level, and the contract's errors."""
    flags = spark.sql(f"SELECT hard, candidate, fallback, empty, truncated FROM {_FLAG_JOIN}")
    d = _texts(spark).withColumn("s", classify.selection(F.col("text"))).withColumn("status", classify.lifecycle(F.col("text"))).crossJoin(F.broadcast(flags))  # 20 x 32 fixture rows
    ref = dedup.reference(F.col("id").cast("string"))
    r = classify.classification(ref, F.col("s"), F.col("status"), F.col("hard"), F.col("candidate"), ~F.col("fallback"), ~F.col("empty"), F.col("truncated"), curate.NOW)
    d = d.withColumn("r", r)
    return d.select("id", "hard", "candidate", "fallback", "empty", "truncated", F.col("r.requiresReview").alias("review"), F.array_join("r.reasonCodes", ",").alias("reasons"), F.col("r.sensitivityLevel").alias("level"), F.size(classify.errors(F.col("r"), expected_id=ref)).cast("long").alias("n_errors"))


_TAXONOMY_SQL = "(VALUES " + ", ".join(f"({_q(c.id)}, {_q(c.label)}, {_q(c.object)}, {_q(c.intent)}, {_q(c.deliverable)}, {_q(c.value)})" for c in P.TAXONOMY) + ") AS x(cid, label, object, intent, deliverable, value)"
_STATUS_SQL = "(VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in P.STATUS_LABELS.items()) + ") AS y(sid, status_label)"


#: A valid result with one field changed at a time: the field, and its value in Spark's SQL.
MUTATIONS = (
    ("conversationId", "'conv:1'"), ("taxonomyVersion", "'mvp-2'"), ("primaryCategoryId", "'none'"), ("primaryCategoryId", "'writing'"), ("projectId", "'p'"), ("intent", "'plan'"), ("deliverableType", "''"), ("lifecycleStatus", "'open'"),
    ("valueLevel", "'V3'"), ("valueLevel", "'V9'"), ("sensitivityLevel", "'S9'"), ("suggestedTitle", "'short'"), ("suggestedTitle", "'[软件开发] 整理另外一个技术问题 · 进行中'"), ("suggestedTitle", "''"), ("tags", "array('a')"), ("tags", "array('1','2','3','4','5','6','7','8','9')"),
    ("riskFlags", "array('X')"), ("riskFlags", "array('SENSITIVE_PATTERN','SENSITIVE_PATTERN')"), ("riskFlags", "array('S3_CANDIDATE')"), ("reasonCodes", "array('UNKNOWN_PROJECT')"), ("reasonCodes", "array('LOW_CONFIDENCE')"), ("reasonCodes", "array('LOW_CONFIDENCE','LOW_CONFIDENCE','UNKNOWN_PROJECT')"),
    ("requiresReview", "false"), ("classifierProvider", "'p'"), ("classifierVersion", "'v'"), ("createdAt", "'yesterday'"),
)
_VALID_SQL = f"""SELECT 'conv:' || {GROUPED} AS "conversationId", '{P.TAXONOMY_VERSION}' AS "taxonomyVersion", 'software-development' AS "primaryCategoryId", NULL::VARCHAR AS "projectId", 'build_or_debug' AS intent, 'code' AS "deliverableType",
  'active' AS "lifecycleStatus", 'V2' AS "valueLevel", 'S0' AS "sensitivityLevel", '[软件开发] 整理技术问题 · 进行中' AS "suggestedTitle", ['software-development', 'active'] AS tags, []::VARCHAR[] AS "riskFlags", ['UNKNOWN_PROJECT', 'LOW_CONFIDENCE'] AS "reasonCodes",
  true AS "requiresReview", '{P.PROVIDER}' AS "classifierProvider", '{P.TAXONOMY_VERSION}' AS "classifierVersion", '{curate.NOW}' AS "createdAt" FROM (SELECT sha256('chatgpt:x') AS h)"""
_MUTATED_SQL = " UNION ALL ".join(f'SELECT {i} AS id, * REPLACE ({v.replace("array(", "[").replace(")", "]") if v.startswith("array") else v} AS "{k}") FROM valid' for i, (k, v) in enumerate(MUTATIONS))
_WITHOUT_REPEATS = lambda c, names: f"""(len("{c}") <= 16 AND len(list_distinct("{c}")) = len("{c}") AND len(list_filter("{c}", lambda x: x NOT IN ({', '.join(_q(n) for n in names)}))) = 0)"""


@query(f"""
WITH valid AS ({_VALID_SQL}), m AS ({_MUTATED_SQL}),
x AS (SELECT m.* RENAME (intent AS m_intent), t.cid IS NOT NULL AS known, t.* RENAME (intent AS t_intent), y.sid IS NOT NULL AS status_known, '[' || label || '] 整理' || object || ' · ' || status_label AS template, {_WITHOUT_REPEATS('riskFlags', P.RISK_FLAGS)} AS risks_ok, {_WITHOUT_REPEATS('reasonCodes', P.REASONS)} AS reasons_ok,
  list_contains("riskFlags", 'SENSITIVE_PATTERN') AS r1, list_contains("riskFlags", 'S3_CANDIDATE') AS r2, list_contains("reasonCodes", 'SENSITIVE_PATTERN') AS c1, list_contains("reasonCodes", 'S3_CANDIDATE') AS c2
  FROM m LEFT JOIN (FROM {_TAXONOMY_SQL}) t ON m."primaryCategoryId" = t.cid LEFT JOIN (FROM {_STATUS_SQL}) y ON m."lifecycleStatus" = y.sid)
SELECT id::BIGINT AS id, array_to_string(list_filter([
  CASE WHEN NOT regexp_full_match("conversationId", 'conv:([a-f0-9]{{8}}:){{7}}[a-f0-9]{{8}}') THEN 'conversationId 必须是本地安全引用' END, CASE WHEN "taxonomyVersion" <> '{P.TAXONOMY_VERSION}' THEN 'taxonomyVersion 无效' END,
  CASE WHEN NOT known THEN 'primaryCategoryId 不存在或已废弃' END, CASE WHEN "projectId" IS NOT NULL THEN 'projectId 必须为 null' END, CASE WHEN m_intent = '' THEN 'intent 无效' END, CASE WHEN "deliverableType" = '' THEN 'deliverableType 无效' END,
  CASE WHEN known AND m_intent <> t_intent THEN 'intent 与 taxonomy 不一致' END, CASE WHEN known AND "deliverableType" <> deliverable THEN 'deliverableType 与 taxonomy 不一致' END, CASE WHEN known AND "valueLevel" <> value THEN 'valueLevel 与 taxonomy 不一致' END,
  CASE WHEN NOT status_known THEN 'lifecycleStatus 无效' END, CASE WHEN "valueLevel" NOT IN ('V0', 'V1', 'V2', 'V3') THEN 'valueLevel 无效' END, CASE WHEN "sensitivityLevel" NOT IN ('S0', 'S1', 'S2', 'S3') THEN 'sensitivityLevel 无效' END,
  CASE WHEN "suggestedTitle" = '' THEN 'suggestedTitle 无效' END, CASE WHEN "suggestedTitle" <> '' AND length("suggestedTitle") NOT BETWEEN 16 AND 30 THEN 'suggestedTitle 长度必须为 16–30 个字符' END,
  CASE WHEN "suggestedTitle" <> '' AND NOT regexp_matches("suggestedTitle", '^[[][^]]{{2,12}}[]] .+ · (进行中|待处理|已完成|已归档)$') THEN 'suggestedTitle 格式或状态无效' END,
  CASE WHEN "suggestedTitle" <> '' AND known AND status_known AND "suggestedTitle" <> template THEN 'suggestedTitle 与 taxonomy 或 lifecycleStatus 不一致' END,
  CASE WHEN len(tags) > 8 THEN 'tags 数量超过 8' END, CASE WHEN known AND status_known AND tags <> ["primaryCategoryId", "lifecycleStatus"] THEN 'tags 与 taxonomy 或 lifecycleStatus 不一致' END,
  CASE WHEN NOT risks_ok THEN 'riskFlags 无效' END, CASE WHEN NOT reasons_ok THEN 'reasonCodes 无效' END, CASE WHEN reasons_ok AND (r1 <> c1 OR r2 <> c2) THEN 'reasonCodes 与 riskFlags 不一致' END,
  CASE WHEN reasons_ok AND NOT list_contains("reasonCodes", 'LOW_CONFIDENCE') THEN 'reasonCodes 与 fieldConfidence 不一致' END, CASE WHEN reasons_ok AND NOT list_contains("reasonCodes", 'UNKNOWN_PROJECT') THEN 'reasonCodes 缺少 UNKNOWN_PROJECT' END,
  CASE WHEN NOT "requiresReview" THEN 'requiresReview 违反强制复核规则' END, CASE WHEN "classifierProvider" <> '{P.PROVIDER}' THEN 'classifierProvider 无效' END, CASE WHEN "classifierVersion" <> '{P.TAXONOMY_VERSION}' THEN 'classifierVersion 无效' END,
  CASE WHEN try_cast("createdAt" AS TIMESTAMP) IS NULL THEN 'createdAt 无效' END], lambda x: x IS NOT NULL), '；') AS errors FROM x""")
def fx_validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract says of a valid result with one field changed at a time."""
    no, yes = F.lit(False), F.lit(True)
    base = spark.range(1).select(F.lit("node api").alias("text"))
    base = base.withColumn("r", classify.classification(dedup.reference(F.lit("x")), classify.selection(F.col("text")), classify.lifecycle(F.col("text")), no, no, yes, yes, no, curate.NOW))
    changed = [F.struct(F.lit(i).cast("long").alias("id"), F.col("r").withField(k, F.expr(f"cast({v} as array<string>)" if v.startswith("array") else v)).alias("r")) for i, (k, v) in enumerate(MUTATIONS)]
    return base.select(F.inline(F.array(*changed))).select("id", F.array_join(classify.errors(F.col("r")), "；").alias("errors"))


SECRET_TEXTS = """SELECT * FROM (VALUES
  (1, 'key: -----BEGIN EC ' || 'PRIVATE KEY----- (cut)'), (2, 'deploy with sk-' || repeat('q7Rt', 5) || '.'), (3, 'ASIA' || repeat('7Q', 8)), (4, 'curl -H bearer ' || repeat('nq4.', 4)), (5, 'basic ' || repeat('Zm9v', 3) || '=='),
  (6, 'ORDERS_PWD : ' || 'harvest'), (7, 'client-secret: "red green blue"'), (8, '密码：no, 密码 = 四季'), (9, 'set-cookie : theme=dark'), (10, 'see amqp://joe:pw@mq.test/v'), (11, 'xoxp-' || repeat('55443-', 3) || '0'), (12, 'a plain sentence'),
  (13, 'pwd=1, passwd=2, pwd=3'), (14, 'github_pat_' || repeat('m0_N', 6)), (15, 'NOPWD=z'), (16, 'x__PWD=z'), (17, 'glpat-' || repeat('w', 18) || ' or npm_' || repeat('u', 22)), (18, 'api_key' || chr(9) || '=' || chr(9) || 'k')
) AS t(id, text)"""
_SQL_DETECTORS = {
    "PRIVATE_KEY": r"(?i)-----BEGIN (?:(?:RSA|EC|OPENSSH|DSA|ENCRYPTED) )?PRIVATE KEY-----|-----BEGIN PGP PRIVATE KEY BLOCK-----",
    "API_KEY": r"\b(?:sk-[A-Za-z0-9_-]{16,}|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{30,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|xox[baprs]-[A-Za-z0-9-]{10,})\b",
    "ACCESS_TOKEN": r"(?i)\b(?:Bearer\s+[A-Za-z0-9._~+/=-]{12,}|Basic\s+[A-Za-z0-9+/]{8,}={0,2})",
    "PASSWORD_FIELD": r"""(?i)(?:\b(?:[A-Z0-9]+_)*(?:PASSWORD|PASSWD|PWD|API[_-]?KEY|ACCESS[_-]?TOKEN|CLIENT[_-]?SECRET|SECRET(?:[_-]?ACCESS)?[_-]?KEY)|密码)["']?\s*[:=]\s*(?:"(?:\\[^\r\n]|[^"\\\r\n])+"|'(?:\\[^\r\n]|[^'\\\r\n])+'|[^\s,;"']+)""",
    "SESSION_CREDENTIAL": r"(?i)\b(?:Cookie|Set-Cookie)\s*:\s*[^\r\n]+",
    "CONNECTION_CREDENTIAL": r"(?i)\b[A-Z][A-Z0-9+.-]{1,15}://[^/\s:@]+:[^@\s/]+@[^\s]+",
}
_SQL_STEPS, _from = [], "f"
for _i, (_kind, _p) in enumerate(_SQL_DETECTORS.items()):
    _SQL_STEPS.append(f"d{_i} AS (SELECT * REPLACE (regexp_replace(text, {_q(_p)}, '[REDACTED:{_kind}]', 'g') AS text), len(regexp_extract_all(text, {_q(_p)})) AS c{_i} FROM {_from})")
    _from = f"d{_i}"


@query(f"WITH f AS ({SECRET_TEXTS}), {', '.join(_SQL_STEPS)} SELECT id::BIGINT AS id, type, cnt::BIGINT AS cnt FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS type, c{i} AS cnt FROM {_from}" for i, k in enumerate(_SQL_DETECTORS)) + ") WHERE cnt > 0")
def fx_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = redact.scan(spark.sql(SECRET_TEXTS), "text")
    rows = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"n_{k}").cast("long").alias("cnt")) for k in P.SECRET_TYPES])
    return d.select(F.col("id").cast("long").alias("id"), F.inline(rows)).where("cnt > 0")


@query(f"WITH f AS ({SECRET_TEXTS}), {', '.join(_SQL_STEPS)} SELECT id::BIGINT AS id, text AS redacted FROM {_from}")
def fx_secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.scan(spark.sql(SECRET_TEXTS), "text").select(F.col("id").cast("long").alias("id"), "redacted")


IDS = """SELECT * FROM (VALUES (1, '000000200001010014'), (2, '000000200001010015'), (3, '110105194912310021'), (4, '11010519491231002X'), (5, '11010519491231002x'), (6, '340524198001010013')) AS t(id, s)"""


@query(f"""
WITH f AS ({IDS}), d AS (SELECT id, s, list_sum(list_transform(range(1, 18), lambda i: substr(s, i::INT, 1)::INT * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i])) AS total FROM f)
SELECT id::BIGINT AS id, substr('10X98765432', (total % 11)::INT + 1, 1) = upper(substr(s, 18, 1)) AS valid FROM d""")
def fx_cn_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IDS).select(F.col("id").cast("long").alias("id"), redact.cn_id(F.col("s")).alias("valid"))


NODES = """SELECT * FROM (VALUES ('a', 'root', NULL, 'root'), ('a', 'q', 'root', 'question'), ('a', 'new', 'q', 'answer-current'), ('a', 'old', 'q', 'answer-old'), ('b', 'n1', '', 'one'), ('b', 'n2', 'n1', 'two'), ('b', 'n3', 'n2', 'three')) AS t(item, node, parent, text)"""
CURRENT = "SELECT * FROM (VALUES ('a', 'new'), ('b', 'n2')) AS t(item, node)"


@query(f"""
WITH RECURSIVE n AS ({NODES}), c AS ({CURRENT}),
w AS (SELECT n.item, n.node, n.parent, n.text, 0 AS up FROM n JOIN c ON n.item = c.item AND n.node = c.node
  UNION ALL SELECT n.item, n.node, n.parent, n.text, w.up + 1 FROM w JOIN n ON n.item = w.item AND n.node = w.parent WHERE w.parent <> '')
SELECT item, row_number() OVER (PARTITION BY item ORDER BY up DESC) AS pos, text FROM w""")
def fx_branch_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current branch of each item, through the export parser."""
    nodes = spark.sql(NODES).groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("parent", F.struct(F.struct(F.array("text").alias("parts")).alias("content")).alias("message"))))).alias("mapping"))
    items = nodes.join(spark.sql(CURRENT), "item").select(F.lit("").alias("path"), F.ascii("item").cast("long").alias("item_index"), F.lit(None).cast("string").alias("run_error"), F.to_json(F.struct(F.col("item").alias("id"), F.col("node").alias("current_node"), "mapping"), {"ignoreNullFields": "false"}).alias("raw"))
    c = export.canonicalized(items)
    return c.select(F.col("source_id").alias("item"), F.posexplode("sampled")).select("item", (F.col("pos") + 1).cast("long").alias("pos"), F.col("col").alias("text"))


@query(f"""WITH {MESSAGES_SQL}, f AS (SELECT conv_id, text FROM v), {', '.join(_SQL_STEPS)}
SELECT conv_id, type, sum(cnt)::BIGINT AS cnt FROM (""" + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS type, c{i} AS cnt FROM {_from}" for i, k in enumerate(_SQL_DETECTORS)) + ") GROUP BY conv_id, type HAVING sum(cnt) > 0")
def conv_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secret scan of whole conversations: messages' counts, added up."""
    c = tables.conversations(tables.table(spark, sf_dir, "conversations"))
    rows = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"n_{k}").alias("cnt")) for k in _SQL_DETECTORS])
    return segments.scans(c, ["item_index"]).select(F.col("item_index").alias("conv_id"), F.inline(rows)).where("cnt > 0")


PARTED = "SELECT * FROM (VALUES (1, 'sk-', repeat('Synthetic9_', 2), ''), (2, 'password=x', ' password=y', ''), (3, 'pass', 'word=z', ' plain')) AS t(id, a, b, c)"


@query(f"""
WITH f AS ({PARTED}), v AS (SELECT id, 0 AS view, a || b || c AS text FROM f UNION ALL SELECT id, 1, a FROM f UNION ALL SELECT id, 1, b FROM f UNION ALL SELECT id, 1, c FROM f),
n AS (SELECT id, view, sum(len(regexp_extract_all(text, {_q(_SQL_DETECTORS['API_KEY'])}))) AS k, sum(len(regexp_extract_all(text, {_q(_SQL_DETECTORS['PASSWORD_FIELD'])}))) AS p FROM v GROUP BY id, view)
SELECT id::BIGINT AS id, max(k)::BIGINT AS api_keys, max(p)::BIGINT AS passwords FROM n GROUP BY id""")
def fx_multipart_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message joined and by its parts: of each rule the larger count."""
    f = spark.sql(PARTED).select(F.col("id").cast("long").alias("id"), F.lit("").alias("title"), F.array(F.struct(F.concat("a", "b", "c").alias("text"), F.array("a", "b", "c").alias("parts"))).alias("messages"))
    return segments.scans(f, ["id"]).select("id", F.col("n_API_KEY").alias("api_keys"), F.col("n_PASSWORD_FIELD").alias("passwords"))


#: Lines and what the privacy detectors make of them.
LINES = """SELECT * FROM (VALUES
  (1, '/home/mia/notes/plan.md', '[REDACTED:POSIX_ABSOLUTE_PATH]'), (2, 'open /srv/q/z now', '[REDACTED:POSIX_ABSOLUTE_PATH]'), (3, 'file:///opt/data.csv', '[REDACTED:LOCAL_FILE_URI]'), (4, '打开file:///home/mia/x', '[REDACTED:LOCAL_FILE_URI]'),
  (5, 'D:/work/mia/draft two.txt', '[REDACTED:POSIX_ABSOLUTE_PATH]'), (6, '目录:/srv/team/budget.xls', '[REDACTED:POSIX_ABSOLUTE_PATH]'), (7, '位置在/opt/b', '[REDACTED:CJK_PATH_CUE]'), (29, 'D:' || chr(92) || 'mia' || chr(92) || 'a.txt', '[REDACTED:WINDOWS_ABSOLUTE_PATH]'),
  (8, 'http://docs.test/guide', 'http://docs.test/guide'), (9, 'sftp://mirror.test/iso/a.img', 'sftp://mirror.test/iso/a.img'), (10, '//assets.test/logo', '//assets.test/logo'), (11, '3/4', '3/4'), (12, '猫/狗', '猫/狗'), (13, '颜色：红/绿/蓝', '颜色：红/绿/蓝'),
  (14, 'a/private/b', 'a/private/b'), (15, 'src/etc/tool', 'src/etc/tool'), (16, 'mia@post.test', '[REDACTED:EMAIL]'), (17, 'write to Mia.K+x@a-b.test, please', 'write to [REDACTED:EMAIL], please'), (18, 'ring +49 30 1234567 today', 'ring [REDACTED:PHONE_NUMBER] today'),
  (19, '0049 30 1234567', '[REDACTED:PHONE_NUMBER]'), (20, '(030) 123-4567', '[REDACTED:PHONE_NUMBER]'), (21, '212.555.0147', '[REDACTED:PHONE_NUMBER]'), (22, '1999-12-31', '1999-12-31'), (23, '23:59', '23:59'), (24, '10.1.2.3', '10.1.2.3'),
  (25, '15912345678', '[REDACTED:CN_MOBILE]'), (26, '+86 15912345678.', '[REDACTED:CN_MOBILE].'), (27, '共 87654321 件', '共 87654321 件'), (28, 'http://localhost:8080/x', 'http://localhost:8080/x')
) AS t(id, text, expected)"""


@query(f"SELECT id::BIGINT AS id, expected AS sanitized, (text <> expected)::BIGINT AS findings FROM ({LINES})")
def fx_privacy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detectors make of each line, and their findings."""
    return redact.sanitize(spark.sql(LINES).select("id", "text"), "text").select(F.col("id").cast("long").alias("id"), "sanitized", "findings")


@query("""SELECT doc_id, sha256(CASE WHEN length(text) > 32768 THEN left(text, 16384) || chr(10) || '[CONTENT_TRUNCATED]' || chr(10) || right(text, 16384) ELSE text END) AS sha, length(text) > 32768 AS truncated FROM documents""")
def doc_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(tables.head_tail(F.col("text")), 256).alias("sha"), (tables.units(F.col("text")) > P.MAX_CHARACTERS).alias("truncated"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def doc_first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("ref"))
    return dedup.first_wins(d, "ref", ["doc_id"]).select("doc_id", "duplicate")


EMAIL_SQL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


@query(f"SELECT doc_id, len(regexp_extract_all(text, {_q(EMAIL_SQL)}))::BIGINT AS n FROM documents WHERE regexp_matches(text, {_q(EMAIL_SQL)})")
def doc_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents").where("contains(text, '@')")
    return d.select("doc_id", F.regexp_count("text", F.lit(P.PRIVACY[0].pattern)).cast("long").alias("n")).where("n > 0")


@query(f"SELECT doc_id, sha256(regexp_replace(text, {_q(EMAIL_SQL)}, '[REDACTED:EMAIL]', 'g')) AS sha FROM documents")
def doc_redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.regexp_replace("text", P.PRIVACY[0].pattern, redact.mark("EMAIL")), 256).alias("sha"))


_LUHN_SQL = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN substr(g, i::INT, 1)::INT WHEN substr(g, i::INT, 1)::INT > 4 THEN 2 * substr(g, i::INT, 1)::INT - 9 ELSE 2 * substr(g, i::INT, 1)::INT END))"


@query(rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[0-9][ -]?)*[0-9]')) AS run FROM documents),
p AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(run, '[0-9]+') AS parts FROM r),
w AS (
  SELECT doc_id, n, parts, 1::BIGINT AS i, NULL::VARCHAR AS g FROM p
  UNION ALL
  SELECT doc_id, n, parts, coalesce(j, i) + 1, array_to_string(parts[i : j], '') FROM (
    SELECT *, list_max(list_filter(range(i, len(parts) + 1), lambda k: length(array_to_string(parts[i : k], '')) BETWEEN 13 AND 19)) AS j FROM w WHERE i <= len(parts)))
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, g FROM w WHERE length(g) BETWEEN 13 AND 19) WHERE {_LUHN_SQL} % 10 = 0 AND length(replace(g, left(g, 1), '')) > 0 GROUP BY doc_id""")
def doc_bank_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers that pass the check. The SQL goes over each run of digit groups as the pattern does: from a group on it
    takes as many as make 13 to 19 digits, and then goes on behind them, or at the next group if there are none."""
    d = redact.scan(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.col("n_BANK_CARD").cast("long").alias("n")).where("n > 0")


_RUNS_SQL = "unnest(regexp_extract_all(text || ' ' || base64(unhex(sha256(text))) || ' ' || sha256(text), '[A-Za-z0-9+/=_-]{32,}'))"


@query(rf"""
WITH r AS (SELECT doc_id, {_RUNS_SQL} AS run FROM documents),
e AS (SELECT doc_id, list_aggregate(list_transform(list_distinct(string_split(run, '')), lambda c: -((length(run) - length(replace(run, c, ''))) / length(run)) * log2((length(run) - length(replace(run, c, ''))) / length(run))), 'sum') AS bits, len(list_distinct(string_split(run, ''))) AS kinds FROM r)
SELECT doc_id, count(*) AS n FROM e WHERE kinds >= 10 AND bits >= 4.2 GROUP BY doc_id""")
def doc_high_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its digest in two forms behind it: in base 64 a candidate mostly, in hexadecimal never."""
    planted = F.concat("text", F.lit(" "), F.base64(F.unhex(F.sha2("text", 256))), F.lit(" "), F.sha2("text", 256))
    runs = tables.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(planted, F.lit(P.ENTROPY.pattern), F.lit(0))).alias("run"))
    return runs.where(redact.entropy(F.col("run"))).groupBy("doc_id").agg(F.count("*").alias("n"))


ENTROPY_TEXTS = "SELECT * FROM (VALUES (1, 'p0Lk-9mN_b8V/c7X+z6A=s5D-f4G_h3J/k2Q'), (2, repeat('z', 44)), (3, repeat('qwertyuiop', 5)), (4, repeat('fedcba9876543210', 2)), (5, 'tiny'), (6, 'zyxwvutsrqponmlkjihgfedcbaZYXWVUT')) AS t(id, run)"


@query(f"""
WITH e AS (SELECT id, run, list_aggregate(list_transform(list_distinct(string_split(run, '')), lambda c: -((length(run) - length(replace(run, c, ''))) / length(run)) * log2((length(run) - length(replace(run, c, ''))) / length(run))), 'sum') AS bits, len(list_distinct(string_split(run, ''))) AS kinds FROM ({ENTROPY_TEXTS}))
SELECT id::BIGINT AS id, length(run) >= 32 AND kinds >= 10 AND bits >= 4.2 AS candidate FROM e""")
def fx_high_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = redact.scan(spark.sql(ENTROPY_TEXTS), "run")
    return d.select(F.col("id").cast("long").alias("id"), redact.candidate().alias("candidate"))


#: A number in front of each text: mobile numbers with and without a country code, and numbers that are none.
_MOBILE = "concat(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '86' WHEN 2 THEN '+86-' ELSE '2' END, CAST(10000000000 + (doc_id * 7919) % 10000000000 AS STRING), ' ')"


@query(rf"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all({_MOBILE} || text, '[0-9]+')) AS run FROM documents)
SELECT doc_id, count(*) AS n FROM r WHERE regexp_full_match(run, '(86)?1[3-9][0-9]{{9}}') GROUP BY doc_id""")
def doc_cn_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese mobile numbers as whole runs of digits, with one planted before each text; a country code with a separator is a run of its own."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.expr(_MOBILE), F.col("text")).alias("text"))
    return d.select("doc_id", F.regexp_count("text", F.lit(P.PRIVACY[1].pattern)).cast("long").alias("n")).where("n > 0")


@query()
def doc_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors in each document; the order of rewrites is beyond SQL."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return redact.sanitize(d, "text").select("doc_id", "findings", F.sha2("sanitized", 256).alias("sha")).where("findings > 0")


_CONV_SQL = f"""
WITH {MESSAGES_SQL},
t AS (SELECT c.conv_id AS id, '{P.UNTITLED}' || coalesce((SELECT string_agg(chr(10) || left(s.text, 32768), '' ORDER BY s.i) FROM s WHERE s.conv_id = c.conv_id AND (n <= 6 OR i <= 3 OR j <= 3)), '') AS text FROM (SELECT DISTINCT conv_id FROM conversations) c),
x AS (SELECT conv_id, bool_or({" OR ".join(f"regexp_matches(text, {_q(p)})" for p in _SQL_DETECTORS.values())}) AS hard, bool_or(visible) AS available FROM v GROUP BY conv_id),
{_classified_sql('t')},
f AS (SELECT g.*, coalesce(x.hard, false) AS hard, coalesce(x.available, false) AS available FROM g LEFT JOIN x ON g.id = x.conv_id)"""


@query(f"""{_CONV_SQL}
SELECT count(*) AS "totalItems", count(*) AS classified, 0::BIGINT AS duplicates, 0::BIGINT AS failed, count(*) FILTER (WHERE available) AS "currentBranchParsed", 0::BIGINT AS "branchFallbacks",
  count(*) FILTER (WHERE NOT available) AS "contentUnavailable", 0::BIGINT AS "classificationTruncated", count(*) FILTER (WHERE hard) AS s3, 0::BIGINT AS "s3Candidates",
  count(*) FILTER (WHERE score >= 2 AND NOT tied AND status <> 'active' AND available AND NOT hard) AS "suggestedAccept",
  count(*) FILTER (WHERE NOT (score >= 2 AND NOT tied AND status <> 'active' AND available AND NOT hard)) AS "requiresReview" FROM f""")
def conv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve counters over the whole plan."""
    return curate.summary(curate.classified(tables.conversations(tables.table(spark, sf_dir, "conversations"))))


@query(f"""{_CONV_SQL}
SELECT id AS conv_id, category, status, CASE WHEN hard THEN 'S3' ELSE 'S0' END AS level, NOT (score >= 2 AND NOT tied AND status <> 'active' AND available AND NOT hard) AS review FROM f""")
def conv_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = curate.classified(tables.conversations(tables.table(spark, sf_dir, "conversations")))
    return d.where("failure IS NULL AND NOT duplicate").select(F.col("item_index").alias("conv_id"), F.col("r.primaryCategoryId").alias("category"), F.col("r.lifecycleStatus").alias("status"), F.col("r.sensitivityLevel").alias("level"), F.col("r.requiresReview").alias("review"))


_REPORT_SQL = f"""{_CONV_SQL},
u AS (SELECT conv_id, text FROM v), {', '.join(x.replace(' FROM f)', ' FROM u)') if x.startswith('d0 ') else x for x in _SQL_STEPS)},
mc AS (SELECT conv_id, string_agg('"' || type || '":' || cnt, ',' ORDER BY rank) AS counts FROM (SELECT conv_id, type, rank, sum(cnt)::BIGINT AS cnt FROM (""" + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS type, {i} AS rank, c{i} AS cnt FROM {_from}" for i, k in enumerate(_SQL_DETECTORS)) + f""") GROUP BY ALL HAVING sum(cnt) > 0) GROUP BY conv_id),
z AS (SELECT f.*, x.*, y.*, '[' || label || '] 整理' || object || ' · ' || status_label AS title, coalesce(mc.counts, '') AS counts,
  (SELECT count(*) FROM v WHERE v.conv_id = f.id) AS n_messages, 'conv:' || (SELECT {GROUPED} FROM (SELECT sha256('chatgpt:' || f.id::VARCHAR) AS h)) AS ref, CASE WHEN hard THEN 'S3' ELSE 'S0' END AS level,
  CASE WHEN score = 0 THEN 0.3::DOUBLE WHEN tied THEN 0.5::DOUBLE WHEN score = 1 THEN 0.68::DOUBLE ELSE 0.84::DOUBLE END AS sure, CASE WHEN status = 'active' THEN 0.55::DOUBLE ELSE 0.8::DOUBLE END AS settled,
  NOT (score >= 2 AND NOT tied AND status <> 'active' AND available AND NOT hard) AS review, NOT (score >= 2 AND NOT tied AND status <> 'active') AS low
  FROM f JOIN {_TAXONOMY_SQL} ON f.category = x.cid JOIN {_STATUS_SQL} ON f.status = y.sid LEFT JOIN mc ON f.id = mc.conv_id)"""


@query(f"{_REPORT_SQL} SELECT id AS conv_id, title, to_json([category, status])::VARCHAR AS tags, sure, settled FROM z")
def conv_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested title, tags and confidences of every conversation, through the whole plan."""
    d = curate.classified(tables.conversations(tables.table(spark, sf_dir, "conversations"))).where("failure IS NULL AND NOT duplicate")
    sure = F.col("r.fieldConfidence")
    return d.select(F.col("item_index").alias("conv_id"), F.col("r.suggestedTitle").alias("title"), F.to_json("r.tags").alias("tags"), sure["suggestedTitle"].alias("sure"), sure["lifecycleStatus"].alias("settled"))


@query(f"""{_REPORT_SQL}
SELECT 0::BIGINT AS section, -1::BIGINT AS item_index, json_object('type', 'header', 'schemaVersion', '{P.SCHEMA_VERSION}', 'generatedAt', '{curate.NOW}', 'source', json_object('platform', 'chatgpt', 'fileName', 'conversations.json', 'sha256', 'sha256:' || left(repeat('00000000:', 8), 71), 'sizeBytes', 0))::VARCHAR AS json
UNION ALL SELECT 1, id, json_object('type', 'conversation', 'data', json_object('conversationRef', ref, 'messageCount', n_messages, 'branchMode', 'current', 'classificationTruncated', false,
  'security', json_object('sensitivityLevel', level, 'hardMatch', hard, 'candidateMatch', false, 'riskFlags', CASE WHEN hard THEN '["SENSITIVE_PATTERN"]' ELSE '[]' END::JSON, 'matchCounts', ('{{' || counts || '}}')::JSON),
  'classification', json_object('conversationId', ref, 'taxonomyVersion', '{P.TAXONOMY_VERSION}', 'primaryCategoryId', category, 'projectId', NULL, 'intent', intent, 'deliverableType', deliverable, 'lifecycleStatus', status, 'valueLevel', value, 'sensitivityLevel', level,
    'suggestedTitle', title, 'tags', to_json([category, status]), 'fieldConfidence', json_object('primaryCategoryId', sure, 'lifecycleStatus', settled, 'suggestedTitle', sure), 'riskFlags', CASE WHEN hard THEN '["SENSITIVE_PATTERN"]' ELSE '[]' END::JSON,
    'reasonCodes', to_json(list_filter(['UNKNOWN_PROJECT', CASE WHEN low THEN 'LOW_CONFIDENCE' END, CASE WHEN tied THEN 'MULTI_TOPIC' END, CASE WHEN hard THEN 'SENSITIVE_PATTERN' END, CASE WHEN NOT available THEN 'EMPTY_CONTENT' END], lambda x: x IS NOT NULL)),
    'requiresReview', review, 'classifierProvider', '{P.PROVIDER}', 'classifierVersion', '{P.TAXONOMY_VERSION}', 'createdAt', '{curate.NOW}')))::VARCHAR FROM z
UNION ALL SELECT 2, -1, json_object('type', 'summary', 'summary', json_object('totalItems', count(*), 'classified', count(*), 'duplicates', 0, 'failed', 0, 'currentBranchParsed', count(*) FILTER (WHERE available), 'branchFallbacks', 0,
  'contentUnavailable', count(*) FILTER (WHERE NOT available), 'classificationTruncated', 0, 's3', count(*) FILTER (WHERE hard), 's3Candidates', 0, 'suggestedAccept', count(*) FILTER (WHERE NOT review), 'requiresReview', count(*) FILTER (WHERE review)),
  'privacy', json_object('networkUsed', false, 'rawMessageBodiesIncluded', false, 'originalTitlesIncluded', false, 'sensitiveValuesIncluded', false, 'crossRunLinkable', true))::VARCHAR FROM z""")
def conv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event stream as JSON: header, an event for each conversation, summary."""
    rows = curate.classified(tables.conversations(tables.table(spark, sf_dir, "conversations"))).persist()
    return curate.events(rows, curate.source_struct("0" * 64, 0)).select(F.col("section").cast("long").alias("section"), "item_index", "json")


@query(f'{_REPORT_SQL} SELECT ref, review AS "requiresReview", title AS "suggestedTitle", level AS "sensitivityLevel" FROM z ORDER BY id LIMIT {P.PREVIEW_ITEMS}')
def conv_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's preview: the first conversations by arrival."""
    return curate.preview(curate.classified(tables.conversations(tables.table(spark, sf_dir, "conversations"))))[0]


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as export files: path and content. All conversations are dealt to five files by id; every
    third points to a node that isn't there, so that its nodes, listed backwards, are ordered by time."""
    t = tables.table(spark, sf_dir, "conversations")
    node = lambda n: F.concat(F.lit("n"), n.cast("string"))
    ranked = t.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    message = F.struct(F.struct("role").alias("author"), F.col("i").alias("create_time"), F.struct(F.array("text").alias("parts")).alias("content"))
    one = F.struct(F.col("i").alias("i"), F.struct(F.when(F.col("i") > 1, node(F.col("i") - 1)).alias("parent"), message.alias("message")).alias("node"))
    grouped = ranked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", F.to_json(one["node"]).alias("json"))), asc=False).alias("nodes"), F.max("i").alias("last"))
    mapping = F.concat(F.lit("{"), F.array_join(F.transform("nodes", lambda x: F.concat(F.lit('"'), node(x["i"]), F.lit('":'), x["json"])), ","), F.lit("}"))
    current = F.when(F.col("conv_id") % 3 == 0, "gone").otherwise(node(F.col("last")))
    head = F.to_json(F.struct(F.concat(F.lit(" c"), F.col("conv_id").cast("string")).alias("id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))).alias("title"), (F.lit(1_600_000_000.25) + F.col("conv_id")).alias("create_time"), current.alias("current_node")))
    item = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"mapping":'), mapping, F.lit("}"))
    files = grouped.select("conv_id", item.alias("item")).groupBy((F.col("conv_id") % 5).alias("file")).agg(F.sort_array(F.collect_list(F.struct("conv_id", "item"))).alias("items"))
    content = F.concat(F.lit("\ufeff [\n"), F.array_join(F.transform("items", lambda x: x["item"]), " ,\n"), F.lit("\n]\n"))
    return files.select(F.concat(F.lit("export-"), F.col("file").cast("string")).alias("path"), F.encode(content, "UTF-8").alias("content"))


@query("SELECT 'export-' || (conv_id % 5)::VARCHAR AS path, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) - 1 AS item_index, 'c' || conv_id::VARCHAR AS source_id FROM (SELECT DISTINCT conv_id FROM conversations)")
def export_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as export files, split and parsed: where each item stood, and its id."""
    return export.canonicalized(export.split_files(_exported(spark, sf_dir))).where("failure IS NULL").select("path", "item_index", "source_id")


@query(f"""
WITH {MESSAGES_SQL},
k AS (SELECT conv_id, count(*) AS n_messages, coalesce(bool_or(visible), false) AS available FROM v GROUP BY conv_id),
q AS (SELECT conv_id, sha256(string_agg(CASE WHEN length(text) > 32768 THEN left(text, 16384) || chr(10) || '[CONTENT_TRUNCATED]' || chr(10) || right(text, 16384) ELSE text END, chr(10) ORDER BY i)) AS sha FROM s WHERE n <= 6 OR i <= 3 OR j <= 3 GROUP BY conv_id)
SELECT 'c' || c.conv_id::VARCHAR AS source_id, CASE WHEN c.conv_id % 2 = 0 THEN 'Talk ' || c.conv_id::VARCHAR ELSE '{P.UNTITLED}' END AS title, strftime(make_timestamp(((1600000000.25 + c.conv_id) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at,
  coalesce(n_messages, 0) AS message_count, coalesce(available, false) AS available, c.conv_id % 3 <> 0 AS current, coalesce(sha, sha256('')) AS sha
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON c.conv_id = k.conv_id LEFT JOIN q ON c.conv_id = q.conv_id""")
def export_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as export files, brought to one form: id, title, time, branch, messages and the sample."""
    c = export.canonicalized(export.split_files(_exported(spark, sf_dir))).where("failure IS NULL")
    return c.select("source_id", "title", "created_at", "message_count", "available", "current", F.sha2(F.array_join("sampled", "\n"), 256).alias("sha"))


TIMES = "SELECT * FROM (VALUES (1, 1700000000.5), (2, 1700000000500.0), (3, 0.0), (4, 9999999999.0), (5, 10000000000.0)) AS t(id, x)"


@query(f"SELECT id::BIGINT AS id, strftime(make_timestamp((CASE WHEN x < 10000000000 THEN x * 1000 ELSE x END * 1000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM ({TIMES})")
def fx_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in seconds and in milliseconds, through the export parser."""
    raw = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.create_map().cast("map<string,string>").alias("mapping"), F.col("x").cast("double").alias("create_time")))
    items = spark.sql(TIMES).select(F.lit("").alias("path"), F.col("id").cast("long").alias("item_index"), F.lit(None).cast("string").alias("run_error"), raw.alias("raw"))
    return export.canonicalized(items).select(F.col("item_index").alias("id"), F.col("created_at").alias("iso"))


HASHES = "SELECT * FROM (VALUES (1, 'a'), (2, ''), (3, 'é')) AS t(id, content)"


@query(f"SELECT id::BIGINT AS id, 'sha256:' || {GROUPED} AS token FROM (SELECT id, sha256(content) AS h FROM ({HASHES}))")
def fx_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HASHES).select(F.col("id").cast("long").alias("id"), curate.source_token(F.sha2("content", 256)).alias("token"))


SUMMARIES = "SELECT * FROM (VALUES (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (2, 3, 2, 0, 1, 2, 0, 0, 0, 0, 0), (3, 3, 2, 1, 0, 2, 0, 0, 0, 0, 0), (4, 2, 2, 0, 0, 1, 1, 0, 0, 0, 0), (5, 2, 2, 0, 0, 2, 0, 0, 0, 1, 0), (6, 2, 2, 0, 0, 2, 0, 0, 0, 0, 0)) AS t(id, totalItems, classified, duplicates, failed, currentBranchParsed, branchFallbacks, contentUnavailable, classificationTruncated, s3, s3Candidates)"


@query(f"""SELECT id::BIGINT AS id, CASE WHEN totalItems = 0 OR classified = 0 THEN 'PRIVATE_SAMPLE_NO_CLASSIFIED_ITEMS' WHEN failed > 0 THEN 'PRIVATE_SAMPLE_PARTIAL_FAILURE' WHEN duplicates > 0 THEN 'PRIVATE_SAMPLE_DUPLICATE_IDS'
  WHEN currentBranchParsed = 0 OR branchFallbacks > 0 OR contentUnavailable > 0 OR classificationTruncated > 0 THEN 'PRIVATE_SAMPLE_STRUCTURE_UNVERIFIED' WHEN s3 > 0 OR s3Candidates > 0 THEN 'PRIVATE_SAMPLE_NOT_DEIDENTIFIED' END AS gate FROM ({SUMMARIES})""")
def fx_compatibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.gate(spark.sql(SUMMARIES)).select(F.col("id").cast("long").alias("id"), "gate")


NESTED = """SELECT * FROM (VALUES
  (1, 'plain', 'mia@post.test', 'also plain', 'k'), (2, 'a b@c.test d', 'x@y.test, z@y.test', 'no', 'k@l.test'), (3, 'nothing', 'here', 'at all', 'to find'), (4, cast(NULL as string), 'q@r.test', cast(NULL as string), 'end')
) AS t(id, a, b, c, d)"""


def _nested(spark: SparkSession) -> DataFrame:
    """Strings in a struct, an array of structs and a map."""
    inner = F.array(F.struct(F.col("b").alias("x")), F.struct(F.col("c").alias("x")))
    return spark.sql(NESTED).select(F.col("id").cast("long").alias("id"), F.struct(F.col("a").alias("name"), F.struct(inner.alias("list"), F.lit(7).alias("n")).alias("sub"), F.create_map(F.lit("key"), F.col("d")).alias("map")).alias("output"))


_EMAILS = lambda c: f"len(regexp_extract_all(coalesce({c}, ''), {_q(EMAIL_SQL)}))"
_CLEAN = lambda c: f"regexp_replace({c}, {_q(EMAIL_SQL)}, '[REDACTED:EMAIL]', 'g')"
_PATHS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_EMAILS(c)} > 0 THEN 'output.{path}' END" for c, path in (("a", "name"), ("b", "sub.list[0].x"), ("c", "sub.list[1].x"), ("d", "map.key"))) + "], lambda x: x IS NOT NULL)"
_NESTED_SQL = NESTED.replace("cast(NULL as string)", "NULL::VARCHAR")


@query(f"""SELECT id::BIGINT AS id, {_CLEAN('a')} AS name, {_CLEAN('b')} AS first, {_CLEAN('c')} AS second, {_CLEAN('d')} AS mapped, ({' + '.join(_EMAILS(c) for c in 'abcd')})::BIGINT AS findings, array_to_string({_PATHS_SQL}, ',') AS paths FROM ({_NESTED_SQL})""")
def fx_deep_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of nested values rewritten, the findings counted, and the paths of those that had some."""
    d = deep.sanitized(_nested(spark), "output")
    return d.select("id", "output.name", F.col("output.sub.list")[0]["x"].alias("first"), F.col("output.sub.list")[1]["x"].alias("second"), F.col("output.map")["key"].alias("mapped"), F.col("output_findings").alias("findings"), F.array_join("output_unsafe", ",").alias("paths"))


@query(f"""SELECT id::BIGINT AS id, CASE WHEN len({_PATHS_SQL}) > 0 THEN '最终输出安全扫描失败（' || array_to_string(list_slice({_PATHS_SQL}, 1, 3), '、') || '）。' END AS message FROM ({_NESTED_SQL})""")
def fx_output_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the failure of each unsafe output says: the first three paths."""
    return deep.assessed(_nested(spark), "output").select("id", F.col("output_failure").alias("message"))


COUNTED = "SELECT * FROM (VALUES (1, 'API_KEY', 2), (2, 'API_KEY', -1), (3, 'PASSWORD', 3), (4, 'PASSWORD_FIELD', 0)) AS t(id, k, n)"


@query(f"SELECT id::BIGINT AS id, CASE WHEN k NOT IN ({', '.join(_q(t) for t in P.SECRET_TYPES)}) OR n < 0 THEN '最终序列化输出安全扫描失败。' END AS message FROM ({COUNTED})")
def fx_counter_exemption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of known detectors aren't assignments of secrets; unknown names and counts that are none stay suspicious."""
    d = spark.sql(COUNTED).select(F.col("id").cast("long").alias("id"), F.struct(F.create_map("k", F.col("n").cast("long")).alias("matchCounts")).alias("output"))
    return deep.assessed(d, "output").select("id", F.col("output_failure").alias("message"))


TAGGED = """SELECT * FROM (VALUES (1, 'mia@post.test', 'active', 'x'), (2, 'software-development', 'active', 'x'), (3, '', 'ring +49 30 1234567', 'x'), (4, 'software-development', 'active', '')) AS t(id, a, b, more)"""


@query(f"""SELECT id::BIGINT AS id, array_to_string(list_filter([
  CASE WHEN more = '' THEN '包含 1 个未知字段' END,
  CASE WHEN length(a) = 0 THEN 'tags[0] 长度无效' END, CASE WHEN contains(a, '@') THEN 'tags[0] 含敏感信息' END, CASE WHEN contains(b, '+') THEN 'tags[1] 含敏感信息' END,
  CASE WHEN a <> 'software-development' OR b <> 'active' THEN 'tags 与 taxonomy 或 lifecycleStatus 不一致' END], lambda x: x IS NOT NULL), '；') AS errors FROM ({TAGGED})""")
def fx_validation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's word on tags and field names, with the detectors' findings in the tags."""
    no, yes = F.lit(False), F.lit(True)
    d = spark.sql(TAGGED).select(F.col("id").cast("long").alias("id"), "a", "b", "more", F.lit("node api").alias("text"))
    r = classify.classification(dedup.reference(F.lit("x")), classify.selection(F.col("text")), classify.lifecycle(F.col("text")), no, no, yes, yes, no, curate.NOW)
    d = redact.sanitize_all(d.withColumn("r", r.withField("tags", F.array("a", "b"))), F.array("a", "b"), "_t", "_n")
    fields = F.when(F.col("more") == "", F.array(*[F.lit(f) for f in (*classify.FIELDS, "note")])).otherwise(F.array(*[F.lit(f) for f in classify.FIELDS]))
    return d.select("id", F.array_join(classify.errors(F.col("r"), fields=fields, private_tags=F.transform("_n", lambda n: n > 0)), "；").alias("errors"))


FIELD_SETS = "SELECT * FROM (VALUES (1, 'tags,intent'), (2, 'tags,note,intent,other'), (3, 'createdAt')) AS t(id, names)"


@query(f"""SELECT id::BIGINT AS id, array_to_string(list_filter([
  CASE WHEN len(list_filter(string_split(names, ','), lambda x: NOT contains('{','.join(classify.FIELDS)}', x))) > 0 THEN '包含 ' || len(list_filter(string_split(names, ','), lambda x: NOT contains('{','.join(classify.FIELDS)}', x))) || ' 个未知字段' END,
  '缺少字段：' || array_to_string(list_filter(string_split('{','.join(classify.FIELDS)}', ','), lambda x: NOT list_contains(string_split(names, ','), x)), '、')], lambda x: x IS NOT NULL), '；') AS errors FROM ({FIELD_SETS})""")
def fx_field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FIELD_SETS).select(F.col("id").cast("long").alias("id"), F.array_join(classify.field_errors(F.split("names", ",")), "；").alias("errors"))


ARTIFACTS = """SELECT * FROM (VALUES
  ('data/talks.json', '[{"x":1},{"id":"t","mapping":{}}]'), ('data/out.json', '[{"type":"header"},{"type":"summary"}]'), ('data/half.json', '[{"type":"header"}]'), ('data/rows.json', '[1,[2],"x"]'), ('data/cut.json', '[{"id":'), ('data/empty.json', '[]'),
  ('src/a.ts', 'let x = 1'), ('src/b.ts', 'fine' || chr(10) || 'pwd=' || 'hush' || chr(13) || chr(10) || 'pwd=' || 'quiet'), ('img/c.bin', 'pwd=' || 'hush'), ('build.log', 'x'), ('dist/a.js', 'y'), ('.env.local', 'z'), ('docs/d.md', 'note # gitleaks' || ':allow'), ('img/e.bin', 'gitleaks' || ':allow')
) AS t(path, content)"""


@query(f"SELECT path, json_valid(content) AND ((contains(content, 'mapping')) OR (contains(content, '\"header\"') AND contains(content, '\"summary\"'))) AS private FROM ({ARTIFACTS}) WHERE path LIKE '%.json'")
def fx_private_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that resemble private exports or reports."""
    return policy.resembling(spark.sql(ARTIFACTS).where("path LIKE '%.json'")).select("path", "private")


@query(f"""
WITH f AS ({ARTIFACTS}), l AS (SELECT path, unnest(regexp_split_to_array(content, '\r?\n')) AS line FROM f),
bad AS (SELECT path, 'PATH' AS rule FROM f WHERE path LIKE 'dist/%' OR path LIKE '.env.%' OR path LIKE '%.log'),
art AS (SELECT path, 'ARTIFACT' AS rule FROM f WHERE path IN ('data/talks.json', 'data/out.json')),
mark AS (SELECT path, 'MARKER' AS rule FROM l WHERE contains(line, 'gitleaks' || ':allow')),
sec AS (SELECT path, 'SECRET' AS rule FROM l WHERE regexp_matches(line, {_q(_SQL_DETECTORS['PASSWORD_FIELD'])}) AND regexp_matches(path, '[.](ts|js|json|yml|yaml|md|toml)$'))
SELECT path, rule, count(*) AS n FROM (FROM bad UNION ALL FROM art UNION ALL FROM mark UNION ALL FROM sec) GROUP BY path, rule""")
def fx_repository_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repository must not hold: paths, artifacts, suppression marks and secrets."""
    return policy.violations(spark.sql(ARTIFACTS)).groupBy("path", "rule").agg(F.count("*").alias("n"))
