"""Detectors against fixtures, and the rewritten patterns against plain forms."""

import random
import re

from pyspark.sql import functions as F

from skeinlake.functions import patterns as P
from skeinlake.functions import redact


def scans(spark, texts):
    d = redact.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text")
    d = d.select("i", "redacted", redact.level(redact.hard(), redact.candidate()).alias("level"), *[f"n_{t}" for t in P.SECRET_TYPES])
    return [r for r in sorted(d.collect(), key=lambda r: r.i)]


#: Key forms: what stands before the random part, its alphabet and its least length.
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
FORMS = [
    *((p, LOWER + DIGITS, 20) for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_", "hf_")),
    *((p, LOWER + DIGITS + "_-", 16) for p in ("sk-", "glpat-")), ("github_pat_", LOWER + DIGITS + "_", 20), ("AIza", LOWER + DIGITS + "_-", 30),
    *((p, LOWER.upper() + DIGITS, 16) for p in ("AKIA", "ASIA")), *((p, LOWER + DIGITS, 16) for p in ("sk_live_", "rk_live_")), *((f"xox{c}-", LOWER + DIGITS, 10) for c in "baprs"),
]


def key(rng, form, cut=0):
    before, alphabet, least = form
    return before + "".join(rng.choice(alphabet) for _ in range(least - 1 - cut)) + (rng.choice(alphabet.replace("-", "")) if not cut else "")


def field_names():
    """Every stem with each separator between its words, alone and behind a prefix."""
    stems = ("password", "passwd", "pwd", "api key", "access token", "client secret", "secret key", "secret access key")
    for stem in stems:
        for sep in ("", "_", "-"):
            if sep == "" and stem == "secret access key" or sep == "_" and " " not in stem or sep == "-" and " " not in stem:
                continue
            yield stem.replace(" ", sep)
            yield "ORDERS_" + stem.replace(" ", sep).upper()


def test_forms(spark):
    rng = random.Random(41)
    exact = [key(rng, f) for f in FORMS]
    fields = [f"{name}{eq}{value}" for name in field_names() for eq in ("=", " : ") for value in ("lantern", "'old lantern'")]
    spaced = [f"pwd{a}={b}{v}" for a in ("", "\u3000", "\t", "\u00a0") for b in ("", "\ufeff") for v in ('"three red lanterns"', '"a \\" b"', "q")]
    texts = exact + fields + spaced + ["密码=四季", "密" + key(rng, FORMS[7])]
    for t, r in zip(texts, scans(spark, texts)):
        assert r.level == "S3", t
        assert t not in r.redacted
    short = [key(rng, f, cut=1) for f in FORMS]
    assert {r.n_API_KEY for r in scans(spark, short)} == {0}
    assert {r.level for r in scans(spark, ["", None, "a plain sentence", "hex = " + DIGITS * 3 + "abcdef"])} == {"S0"}


def test_order_and_checks(spark):
    rng = random.Random(42)
    token = key(rng, FORMS[7])
    card = lambda base: base + str(-sum(int(d) if (len(base) - i) % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(base)) % 10)
    good = card("400000001234567")
    wrong = good[:-1] + str((int(good[-1]) + 1) % 10)
    split = lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4))
    each = "-".join(good)
    r = scans(spark, [f"{token}; 密码=x; {split(good)}", f"API_KEY={token}", "p0Lk-9mN_b8V/c7X+z6A=s5D-f4G_h3J/k2Q", f"{split(wrong)} {'2' * 16}", each, f"{good} {good}"])
    assert (r[0].n_API_KEY, r[0].n_PASSWORD_FIELD, r[0].n_BANK_CARD) == (1, 1, 1)
    assert (r[1].n_API_KEY, r[1].n_PASSWORD_FIELD, r[1].redacted) == (1, 1, "[REDACTED:PASSWORD_FIELD]")
    assert (r[2].level, r[2].redacted) == ("S2", "[REDACTED:HIGH_ENTROPY_CANDIDATE]")
    assert r[3].level == "S0"
    assert (r[4].n_BANK_CARD, r[5].n_BANK_CARD) == (1, 2)  # a separator after each digit; two cards with one blank between


def test_password_pattern_equals_plain_form(spark):
    stem = "(?:PASSWORD|PASSWD|PWD|API[_-]?KEY|ACCESS[_-]?TOKEN|CLIENT[_-]?SECRET|SECRET(?:[_-]?ACCESS)?[_-]?KEY)"
    plain = re.compile(rf"""(?:\b(?:[A-Z0-9]+_)*{stem}|密码)["']?\s*[:=]\s*(?:"(?:\\[^\r\n]|[^"\\\r\n])+"|'(?:\\[^\r\n]|[^'\\\r\n])+'|[^\s,;"']+)""", re.I | re.A)
    rng = random.Random(7)
    bits = ["password", "PWD", "api", "_", "__", "-", "key", "A", "b", "1", "=", ":", " ", "\n", '"', "'", "\\", ",", ";", "密码", "client_secret", "secret", "access", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(2, 9))) for _ in range(20000)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    pattern = next(p.pattern for p in P.SECRETS if p.type == "PASSWORD_FIELD")
    got = {r.i: r.m for r in d.select("i", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m")).collect()}
    assert all(got[i] == [m.group() for m in plain.finditer(t)] for i, t in enumerate(texts))
    assert sum(map(bool, got.values())) > 300


def test_long_inputs_do_not_overflow(spark):
    texts = ["password=" + '"' + "\\a" * 200_000 + '"', "A_" * 200_000 + "PASSWORD=x", "/a" * 100_000, "1 " * 100_000]
    assert [r.level for r in scans(spark, texts)][:2] == ["S3", "S3"]


def test_privacy(spark):
    bs = chr(92)
    private = ["mia@post.test_15912345678.csv", "030 1234-567 890", "212 555 0147", f"E:{bs}team{bs}q.xls", f"看E:{bs}mia{bs}b.doc", "位置在/srv/disk/c", "004930123456789", "+49.30.1234.5678"]
    fine = ["ws://feed.test/a", "31-12-1999", "第 4321-8765 号", "1999/12/31", "早/中/晚 都行", "段落 甲/乙/丙 三种", "猫/狗 二选一", "team/home/list", "4.5.6", "D://y"]
    d = spark.createDataFrame([(t,) for t in private + fine], "text string")
    got = {r.text: r for r in redact.sanitize(d, "text").collect()}
    assert all(got[t].findings > 0 and t not in got[t].sanitized for t in private)
    assert [t for t in fine if got[t].findings] == []
    lines = redact.sanitize(spark.createDataFrame([("one\r\nsee /srv/team plans/q y.txt\nthree",)], "text string"), "text").first()
    assert lines.sanitized == "one\r\n[REDACTED:POSIX_ABSOLUTE_PATH]\nthree"
    c = redact.sanitize(spark.createDataFrame([("mia@post.test",)], "text string"), "text").select(redact.context(F.col("sanitized")).alias("c")).first().c
    assert c == " "


def plain_chain(text):
    """All detectors, one after the other, with Python's patterns and own checks."""
    import math
    from collections import Counter

    import regex

    def luhn(m):
        d = [int(c) for c in m if c.isdigit()][::-1]
        return len(set(d)) > 1 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    def cn_id(m):
        return "10X98765432"[sum(int(c) * w for c, w in zip(m, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2))) % 11] == m[17].upper()

    def entropy(m):
        n = Counter(m).values()
        return len(n) >= 10 and -sum(x / len(m) * math.log2(x / len(m)) for x in n) >= 4.2

    def phone(m):
        d, t = re.sub("[^0-9]", "", m), m.strip()
        abroad = t.startswith("00")
        if regex.fullmatch(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}", t) or not 8 <= len(d) - 2 * abroad <= 15:
            return False
        if abroad:
            return bool(regex.fullmatch(r"00[1-9][0-9]{7,14}", t) or regex.match(r"00[1-9][0-9]{0,2}[ ().-]", t))
        return not regex.match("0[0-9]", t) or (bool(regex.search("[ ().-]", t)) and len(d) >= 9)

    checks, found = {"luhn": luhn, "cn_id": cn_id, "entropy": entropy, "phone": phone, None: lambda m: True}, 0
    for d in (*P.SECRETS, P.ENTROPY, *P.PRIVACY):
        def rewrite(m, d=d):
            nonlocal found
            ok = checks[d.check](m.group())
            found += ok
            return redact.mark(d.type) if ok else m.group()

        text = regex.sub(d.pattern.replace("(?iu)", "(?i)"), rewrite, text)
    text, more = redact.redact_lines(text)
    return text, found + more


def test_whole_chain_against_python(spark):
    """Every detector over every document, against a plain version that is applied one rewrite after the other."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += [t for t in (r.text for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()) if t]
    got = {r.text: (r.sanitized, r.findings) for r in redact.sanitize(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()}
    want = {t: plain_chain(t) for t in texts if t is not None}
    assert {t: got[t] for t in want} == want and sum(n for _, n in want.values()) > 20
