"""What is looked at before a costly pattern is run, against the pattern alone, and what of a row Python sees."""

import random
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import functions as F

from skeinlake.functions import classify, redact
from skeinlake.functions import patterns as P

LOWER = "abcdefghijklmnopqrstuvwxyz"


def mixed(rng, bits, n):
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_python_sees_only_texts_with_a_slash(spark):
    d = redact.sanitize(spark.createDataFrame([("see /srv/team", "wide")], "text string, other string"), "text")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert d.first().asDict() == {"text": "see /srv/team", "other": "wide", "sanitized": "[REDACTED:POSIX_ABSOLUTE_PATH]", "findings": 1}
    lists = pa.array([[], [None, "see /srv/team"], None, ["no path: a/b", "E:\\q\n/srv/x"]], pa.list_(pa.string()))
    lines = f"{redact.mark('WINDOWS_ABSOLUTE_PATH')}\n{redact.mark('POSIX_ABSOLUTE_PATH')}"
    assert redact._line_rules(lists.slice(1)).to_pylist() == [[None, {"t": "[REDACTED:POSIX_ABSOLUTE_PATH]", "n": 1}], [], [None, {"t": lines, "n": 2}]]


def test_status_cues_are_judged_once(spark):
    cue = P.CUES[0][1].removeprefix("(?iu)")
    plan = spark.range(1).select(classify.lifecycle(F.concat(F.lit("finished"), F.col("id").cast("string"))).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(cue) == 1


def test_cues_against_patterns(spark):
    rng = random.Random(61)
    bits = ["done", "DONE", "fin\u0131shed", "F\u0130NISHED", "re\u017folved", "re\u017fOLVED", "not ", "not yet ", "un", " ", ".", "_", "pending", "todo", "arch\u0131ved", "archived", "已完成", "没有", "完成", "等待", "x", "incomplete", "completed"]
    d = spark.createDataFrame([(t,) for t in mixed(rng, bits, 4000)], "text string")
    has = lambda p: F.rlike("text", F.lit(p))
    n = reduce(lambda a, b: a + b, [has(p).cast("int") for _, p in P.CUES])
    plain = reduce(lambda other, c: F.when(has(c[1]), c[0]).otherwise(other), P.CUES, F.lit("active"))
    want = F.when(has(P.NEGATION) | (n != 1), "active").otherwise(plain)
    rows = d.select("text", classify.lifecycle(F.col("text")).alias("got"), want.alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == [] and {r.got for r in rows} == {"active", *(c for c, _ in P.CUES)}
    keywords = [k for c in P.TAXONOMY for k in c.keywords if k.isascii()]
    texts = spark.createDataFrame([(t,) for t in mixed(rng, [*keywords, " ", "_", "x", "é"], 1000)], "text string")
    alone = [F.rlike("text", F.lit(rf"(?<![a-z0-9_]){k}(?![a-z0-9_])")) for k in keywords]
    assert texts.where(reduce(or_, [classify.keyword_found(F.col("text"), k) != a for k, a in zip(keywords, alone)])).count() == 0


def test_detectors_look_no_more_often_than_needed(spark):
    """Plain prose with digits, dashes and common words makes no detector run its pattern."""
    text = "the rapid client of 2019 thought that access to the basin is high - 12 of 30 tasks, through the capital"
    d = spark.createDataFrame([(text,)], "text string")
    assert d.select(*[redact._hinted(F.col("text"), x).alias(x.type) for x in (*P.SECRETS, P.ENTROPY, *P.PRIVACY)]).first().asDict() == {x.type: False for x in (*P.SECRETS, P.ENTROPY, *P.PRIVACY)}


def test_quick_looks_lose_no_match(spark):
    """Whatever stands in a text: where a pattern matches, its quick look finds it too; words as in ASCII's lower case."""
    rng = random.Random(62)
    bits = ["1", "13", "86", "+", "(", ")", " ", "-", ".", "00", "212", "5550147", "1234567", "12345678901234567", "X", "4000 0000 ", "sk-", "ghp_", "gho_", "rk_live_", "xoxb-", "AKIA", "npm_", "A" * 16, "a1B2c3D4e5F6g7H8i9J0", "Bearer ", "BASIC ", "aGVsbG8gd29ybGQ=", "Cookie", ":", "=", "password", "API_KEY", "api\u212aey", "密码", "https://u:p@h", "mia@post.test", "-----BEGIN PRIVATE KEY-----", "\n", "q", "é"]
    d = spark.createDataFrame([(t,) for t in mixed(rng, bits, 20000)], "text string")
    found = {}
    for x in (*P.SECRETS, P.ENTROPY, *P.PRIVACY):
        own = F.translate("text", LOWER.upper(), LOWER) if x.folded else F.col("text")
        named = reduce(or_, [F.contains(own, F.lit(h)) for h in x.hints], F.lit(not x.hints))
        match = named & F.rlike("text", F.lit(x.pattern))
        found[x.type] = d.agg(F.count_if(match).alias("n"), F.count_if(match & ~redact._hinted(F.col("text"), x)).alias("lost")).first()
    assert {t: r.lost for t, r in found.items()} == dict.fromkeys(found, 0) and min(r.n for r in found.values()) > 2
