"""Quality rules: gradient-boosted trees over document statistics.

Statistics are counted over every whole text. The trees are fitted in numpy on
at most ``max_labels`` labelled rows (those whose id hashes lowest, so that the
choice doesn't depend on order or partitions), with logistic loss on histogram
bins and monotone constraints on chosen features, and are flattened into node
arrays that score whole batches at once.

Cases: a null or empty text has no words and fails the base rule; repeated rows
are judged alike and each is returned; labels that are null, or of documents
that aren't there, are left out; without labels of both kinds there is no model
and the base rule alone decides. Other columns of docs pass through ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, textcore

MAX_LABELS = 4000
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
THRESHOLD = 0.5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!?.,;:")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines")
#: Each feature and the sign of its effect on quality: -1 if more of it never raises the score, 0 if free.
FEATURES = (("words", 0), ("word_length", 0), ("symbols", -1), ("duplicate_lines", -1), ("repeats", -1), ("upper", -1), ("digits", 0), ("marks", 0), ("line_words", 0))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it occurs again anywhere, and whether it did before (earliest first)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    before[order[1:][same]] = True
    return again, before


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    w = textcore.words(texts)
    salt = textcore.mix(np.arange(w.rows, dtype=np.uint64) + np.uint64(77))
    hashes = w.hashes()
    grams, at = textcore.windows(hashes, w.row, REPEAT_WINDOW)
    again, _ = _repeated(grams ^ salt[w.row[at]])
    covered = textcore.cover(at[again], REPEAT_WINDOW, len(hashes))
    lines = textcore.spans(texts, textcore.LINE)
    held = np.zeros(len(lines.starts), bool)
    held[np.searchsorted(lines.starts, w.starts, "right") - 1] = True
    _, before = _repeated((lines.hashes() ^ salt[lines.row])[held])
    per_text = lambda kind: textcore.sums(kind[w.data], w.offsets)
    return {
        "n_words": w.per_row(), "word_chars": w.per_row(textcore.code_points(w)), "n_symbols": per_text(SYMBOLS),
        "n_dup_lines": np.bincount(lines.row[held][before], minlength=w.rows).astype(np.int64), "n_repeat_words": w.per_row(covered),
        "n_upper": per_text(UPPER), "n_digits": per_text(DIGIT), "n_marks": per_text(MARKS),
        "n_lines": np.bincount(lines.row[held], minlength=w.rows).astype(np.int64),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    n, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / n, s["n_dup_lines"] / lines, s["n_repeat_words"] / n, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / n, np.log(n / lines)], axis=1)


@dataclass
class Trees:
    """Flat nodes of all trees: a leaf has feature -1; left and right are node numbers."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                goes_left = x[rows, np.maximum(f, 0)] <= self.cut[node]
                node = np.where(f < 0, node, np.where(goes_left, self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss. A split on a signed feature must order its sides' values that way,
    and bounds passed to the children keep the order throughout the tree."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    raw = np.full(len(y), bias)
    nodes: list[list[float]] = []
    roots = []

    def value(g: float | np.ndarray, h: float | np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip(-g / (h + ridge), low, high)

    def gain(g: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        return -(g * v + 0.5 * (h + ridge) * v * v)

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, low: float, high: float, left: int) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        own = float(value(g, h, low, high))
        nodes.append([-1, 0.0, me, me, own * rate])
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j, c in enumerate(cuts) if left else ():
            if not len(c):
                continue
            b = binned[rows, j]
            gl, hl = (np.cumsum(np.bincount(b, z[rows], len(c) + 1))[:-1] for z in (grad, hess))
            vl, vr = value(gl, hl, low, high), value(g - gl, h - hl, low, high)
            won = gain(gl, hl, vl) + gain(g - gl, h - hl, vr) - gain(g, h, own)
            won[(hl < least / 4) | (h - hl < least / 4) | (signs[j] * (vr - vl) < 0)] = -1
            k = int(won.argmax())
            if won[k] > best[0]:
                best = (float(won[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j >= 0:
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
            goes_left = binned[rows, j] <= k
            nodes[me][0], nodes[me][1] = j, float(cuts[j][k])
            nodes[me][2] = grow(rows[goes_left], grad, hess, *bounds[0], left - 1)
            nodes[me][3] = grow(rows[~goes_left], grad, hess, *bounds[1], left - 1)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, depth))
        part = flat(nodes, [roots[-1]], 0.0, depth)
        raw = raw + part.raw(x)
    return flat(nodes, roots, bias, depth)


def flat(nodes: list[list[float]], roots: list[int], bias: float, depth: int) -> Trees:
    a = np.array(nodes, float).reshape(-1, 5)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), bias, depth)


def _counted(docs: DataFrame, more: str = "") -> DataFrame:
    """doc_id, the counts, and ``more`` (the name of a long column to keep) of every row."""
    keep = ["doc_id", more] if more else ["doc_id"]
    schema = pa.schema([*((k, pa.int64()) for k in keep), *((c, pa.int64()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                yield frames.batch(schema, **{k: part.column(k) for k in keep}, **statistics(part.column("text")))

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Trees | None:
    """Trees from labels.quality (1 good, 0 bad) of at most ``max_labels`` labelled documents."""
    kinds = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    sample = kinds.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    sample = frames.stored(sample, "labels")
    chosen = frames.ids(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    # a row an id, so as many rows as labels at most: of an id with several texts, that with the least counts
    rows = _counted(chosen, "quality").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c")).orderBy("doc_id").select("quality", "c.*").toPandas()
    y = rows["quality"].to_numpy(float) if len(rows) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return None
    return fit(features({c: rows[c].to_numpy() for c in COUNTS}), y, tuple(s for _, s in FEATURES))


def verdict(s: dict[str, np.ndarray], model: Trees | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and score of each text."""
    failed = base_failed(s)
    score = model.score(features(s)) if model is not None else np.ones(len(failed))
    return failed, ~failed & (score >= threshold), score


def judged(docs: DataFrame, model: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every row of docs."""
    frames.ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                s = statistics(part.column("text"))
                failed, kept, score = verdict(s, model, threshold)
                yield frames.batch(schema, doc_id=part.column("doc_id"), base_failed=failed, kept=kept, score=score, **s)

    return frames.ids(docs).mapInArrow(run, ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'double' if f.type == pa.float64() else 'long'}" for f in schema))


def accepted(docs: DataFrame, model: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with the columns as they are."""
    frames.ready(docs.sparkSession)
    names = docs.columns
    at = [n.lower() for n in names].index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, f"c{at}"):
                yield part.filter(pa.array(verdict(statistics(part.column(at)), model, threshold)[1]))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    model = train(docs, frames.table(spark, sf_dir, "labels"))
    return judged(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
