"""Secret and privacy detection as a chain of columns.

Each detector counts and rewrites what the one before it left. The chain is one
expression in which each step is bound once (see let), so neither the plan nor the
work grows with the number of uses; all but the line-wise path rules stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from operator import and_, or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def mark(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def cn_id(m: Column) -> Column:
    """Whether the weighted sum of the first 17 digits leads to the last character."""
    weights = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
    total = sum((F.substring(m, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return F.substr(F.lit("10X98765432"), total % 11 + 1, F.lit(1)) == F.upper(F.substring(m, 18, 1))


def luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        doubled = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, doubled).otherwise(x)

    varied = F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) > 0
    return varied & (F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0)


def entropy(m: Column) -> Column:
    n = F.length(m)
    kinds = F.array_distinct(F.split(m, ""))
    share = lambda c: (n - F.length(F.replace(m, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(kinds, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return (F.size(F.filter(kinds, lambda c: c != "")) >= P.LEAST_DISTINCT) & (bits >= P.LEAST_ENTROPY)


def phone(m: Column) -> Column:
    d, t = _digits(m), F.regexp_replace(m, f"^[{P.SPACE}]+|[{P.SPACE}]+$", "")
    abroad = F.startswith(t, F.lit("00"))
    n = F.length(d) - F.when(abroad, 2).otherwise(0)
    date = F.rlike(t, F.lit(r"^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})\z"))
    bad_abroad = abroad & ~F.rlike(t, F.lit(r"^00[1-9][0-9]{7,14}\z")) & ~F.rlike(t, F.lit(r"^00[1-9][0-9]{0,2}[ ().-]"))
    bad_trunk = F.rlike(t, F.lit("^0[0-9]")) & ~abroad & (~F.rlike(t, F.lit("[ ().-]")) | (F.length(d) < 9))
    return n.between(8, 15) & ~date & ~bad_abroad & ~bad_trunk


CHECKS = {"cn_id": cn_id, "luhn": luhn, "entropy": entropy, "phone": phone}


def _hinted(text: Column, d: P.Detector) -> Column:
    """Whether the detector may find something; costs far less than its pattern, which looks around at every character."""
    held = lambda h: F.rlike(text, F.lit(f"(?i){h}")) if d.folded and h.lower() != h.upper() else F.contains(text, F.lit(h))
    tests = ([F.rlike(text, F.lit(d.needs))] if d.needs else []) + ([reduce(or_, map(held, d.hints))] if d.hints else [])
    return reduce(and_, tests)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it: Catalyst doesn't inline into a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _step(state: Column, d: P.Detector) -> Column:
    """state: struct(t, n), a text and the counts so far; the text rewritten by the detector, and its count appended."""
    if d.check is None:
        counted = let(state, lambda s: F.struct(s["t"].alias("t"), s["n"].alias("n"), F.when(_hinted(s["t"], d), F.regexp_count(s["t"], F.lit(d.pattern))).otherwise(0).alias("c")))
        return let(counted, lambda q: F.struct(F.when(q["c"] > 0, F.regexp_replace(q["t"], d.pattern, mark(d.type))).otherwise(q["t"]).alias("t"), F.array_append(q["n"], q["c"]).alias("n")))
    check = CHECKS[d.check]
    judged = lambda t: F.transform(F.regexp_extract_all(t, F.lit(d.pattern), F.lit(0)), lambda m: F.struct(m.alias("m"), check(m).alias("ok")))
    none = F.array().cast("array<struct<m:string,ok:boolean>>")
    found = let(state, lambda s: F.struct(s["t"].alias("t"), s["n"].alias("n"), F.when(_hinted(s["t"], d), judged(s["t"])).otherwise(none).alias("m")))

    def rewritten(q: Column) -> Column:
        piece = lambda g, x: F.concat(g, F.when(x.isNull(), "").when(x["ok"], mark(d.type)).otherwise(x["m"]))
        c = F.size(F.filter(q["m"], lambda x: x["ok"]))
        text = F.when(F.exists(q["m"], lambda x: x["ok"]), F.array_join(F.zip_with(F.split(q["t"], d.pattern, -1), q["m"], piece), "")).otherwise(q["t"])
        return F.struct(text.alias("t"), F.array_append(q["n"], c).alias("n"))

    return let(found, rewritten)


def _chain(text: Column, detectors: Sequence[P.Detector]) -> Column:
    """struct(t, n). Where no detector may find something in the text as it is, none gets to see another one, and no
    step is taken."""

    def steps(t: Column) -> Column:
        state = F.struct(t.alias("t"), F.array().cast("array<int>").alias("n"))
        for d in detectors:
            state = _step(state, d)
        nothing = F.struct(t.alias("t"), F.array(*[F.lit(0) for _ in detectors]).alias("n"))
        return F.when(reduce(or_, [_hinted(t, d) for d in detectors]), state).otherwise(nothing)

    return let(F.coalesce(text, F.lit("")), steps)


@lru_cache(8)
def _built(session: int, name: str, detectors: tuple[P.Detector, ...], each: bool) -> Column:
    """The chain over a column, or over each text of an array. A plan's expression takes thousands of calls to build, and
    is the same for every frame that has a column of that name: it is built once a session."""
    return F.transform(F.col(name), lambda t: _chain(t, detectors)) if each else _chain(F.col(name), detectors)


def _chained(df: DataFrame, name: str, detectors: tuple[P.Detector, ...], each: bool) -> Column:
    return _built(id(df.sparkSession._jvm), name, detectors, each)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column of its own: by a generator, below which no filter on it is pushed, so that it stands in
    the plan once."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def scan(df: DataFrame, text: str, redacted: str = "redacted") -> DataFrame:
    """df with the rewritten text and n_<TYPE> of every secret detector. A null text is empty."""
    df = df.withColumn("_text", F.col(text))
    df = _held(df, "_s", _chained(df, "_text", (*P.SECRETS, P.ENTROPY), False)).drop("_text")
    return df.withColumns({redacted: F.col("_s.t")} | {f"n_{t}": F.element_at("_s.n", i + 1) for i, t in enumerate(P.SECRET_TYPES)}).drop("_s")


def hard() -> Column:
    return sum((F.col(f"n_{d.type}") for d in P.SECRETS[1:]), F.col(f"n_{P.SECRETS[0].type}")) > 0


def candidate() -> Column:
    return F.col(f"n_{P.ENTROPY.type}") > 0


def level(hard: Column, candidate: Column) -> Column:
    return F.when(hard, "S3").when(candidate, "S2").otherwise("S0")


@lru_cache(1)
def _compiled():
    import regex

    return (
        [(kind, regex.compile(p)) for kind, p in P.LINE_PRIVACY],
        regex.compile(r"\r?\n"),
        regex.compile(rf"(?i)[A-Z][A-Z0-9+.-]*://[^{P.PY_SPACE}\"'<>]*\Z"),
        regex.compile(rf"(?:^|[{P.PY_SPACE}(\"'\[{{])//[^{P.PY_SPACE}\"'<>]*\Z"),
        regex.compile(r"\p{Script=Han}{1,2}"),
        regex.compile(r"[\p{L}\p{N}]"),
        regex.compile(rf"/(?:{'|'.join(P.ROOTS)})(?:/|\Z)"),
        regex.compile(r"(?i)[A-Z][A-Z0-9+.-]*"),
    )


def _tail(line: str, at: int, ok) -> str:
    """The longest end of line[:at] whose characters all pass."""
    i = at
    while i and ok(line[i - 1]):
        i -= 1
    return line[i:at]


def _is_posix(match: str, at: int, line: str) -> bool:
    _, _, url, relative, han, letter, root, _ = _compiled()
    prefix = line[:at]
    if url.search(prefix) or relative.search(prefix):
        return False
    if not at or not letter.match(line[at - 1]):
        return True
    options = match[1:].split("/")
    if len(_tail(line, at, lambda c: han.fullmatch(c))) == 1 and len(options) >= 2 and all(han.fullmatch(o) for o in options):
        return False
    return bool(root.match(match)) or "/" in match[1:]


def _is_windows(match: str, at: int, line: str) -> bool:
    if match[2:3] != "/" or line[at + 3 : at + 4] != "/":
        return True
    scheme = _compiled()[7]
    before = _tail(line, at, lambda c: c.isascii() and (c.isalnum() or c in "+.-"))
    while before and not before[0].isalpha():
        before = before[1:]
    return not scheme.fullmatch(before + match[0])


PATH_CHECKS = {"POSIX_ABSOLUTE_PATH": _is_posix, "WINDOWS_ABSOLUTE_PATH": _is_windows}


def redact_lines(text: str) -> tuple[str, int]:
    """text with every line that holds a local path redacted, rule after rule, and the number of findings."""
    rules, ends, *_ = _compiled()
    findings = 0
    for kind, pattern in rules:
        if not pattern.search(text):
            continue
        check, out, at = PATH_CHECKS.get(kind), [], 0
        for cut in [*((m.start(), m.end()) for m in ends.finditer(text)), (len(text), len(text))]:
            line = text[at : cut[0]]
            n = sum(check is None or check(m.group(), m.start(), line) for m in pattern.finditer(line))
            findings += n
            out += [mark(kind) if n else line, text[cut[0] : cut[1]]]
            at = cut[1]
        text = "".join(out)
    return text, findings


_CHANGED = T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.LongType())])


def _line_rules(lists: pa.Array) -> pa.Array:
    """Of arrays of texts, in place of each text: its struct(t, n), text and findings, after redact_lines; null if it is
    null or has no findings. One text at a time is a Python string."""
    texts, kind = lists.flatten(), pa.struct([("t", pa.string()), ("n", pa.int64())])
    found = [None] * len(texts)
    for i in pc.indices_nonzero(pc.is_valid(texts)).to_pylist():
        t, n = redact_lines(texts[i].as_py())
        if n:
            found[i] = {"t": t, "n": n}
    ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.list_value_length(lists), 0), pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pa.array(found, kind))


def _with_slash(t: Column) -> Column:
    """The text if a path rule may find something in it, else null."""
    return F.when(F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\")), t)


def sanitize_all(df: DataFrame, texts: Column, out: str, findings: str) -> DataFrame:
    """df with an array of texts, none of them null, rewritten by all secret and privacy detectors, and the findings in each.

    Python sees the texts with a slash and no other column; its batches are cut by bytes (Spark's own bound, 64 MB)."""
    df = df.withColumn("_texts", texts)
    df = _held(df, "_s", _chained(df, "_texts", (*P.SECRETS, P.ENTROPY, *P.PRIVACY), True)).drop("_texts")
    rules = F.arrow_udf(_line_rules, T.ArrayType(_CHANGED))
    df = _held(df, "_l", rules(F.transform("_s", lambda s: _with_slash(s["t"]))))
    total = lambda s: F.aggregate(s["n"], F.lit(0), lambda acc, x: acc + x).cast("long")
    rewritten = F.zip_with("_s", "_l", lambda s, x: F.coalesce(x["t"], s["t"]))
    counts = F.zip_with("_s", "_l", lambda s, x: total(s) + F.coalesce(x["n"], F.lit(0)))
    return df.withColumns({out: rewritten, findings: counts}).drop("_s", "_l")


def sanitize(df: DataFrame, text: str, out: str = "sanitized", findings: str = "findings") -> DataFrame:
    """df with the text rewritten by all secret and privacy detectors, and the number of findings."""
    df = sanitize_all(df, F.array(F.coalesce(F.col(text), F.lit(""))), "_ts", "_ns")
    return df.withColumns({out: F.element_at("_ts", 1), findings: F.element_at("_ns", 1)}).drop("_ts", "_ns")


def context(sanitized: Column) -> Column:
    """Sanitized text for the classifier: marks become a space, so that no mark holds a keyword."""
    return F.regexp_replace(sanitized, r"\[REDACTED:[A-Z0-9_]+\]", " ")
