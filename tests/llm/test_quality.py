import random
import re

import numpy as np

from skeinlake.llm import quality as Q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    cover = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "é " * 9, "x y z u v " * 3, "a\nb\na\n\n \n \nb\r\nb"]
    texts += ["".join(rng.choice(["a", "bé", "c#", "%%", " d"]) + rng.choice([" ", "\n", "\t", " "]) for _ in range(rng.choice([3, 20, 300]))) for _ in range(60)]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string, n_words int")
    got = {(r.doc_id): (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.judged(d, None).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i] == (*want, want[0] < 10 or 100 * want[4] > 20 * want[0]), t
    assert Q.accepted(d, None).columns == d.columns


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(8 * x[:, 0] + 3 * np.sin(9 * x[:, 1]) - 4))).astype(float)
    model = Q.fit(x[:2000], y[:2000], (-1, 0, 0))
    p = model.score(x[2000:])
    assert np.mean((p > 0.5) == y[2000:]) > 0.8
    grid = np.repeat(rng.random((200, 1, 3)), 50, 1)
    grid[:, :, 0] = np.linspace(0, 1, 50)
    assert (np.diff(model.raw(grid.reshape(-1, 3)).reshape(200, 50), axis=1) <= 1e-12).all()


def walk(model, node, x):
    """The leaf's value, by recursion over one row."""
    f = int(model.feature[node])
    if f < 0:
        return model.value[node]
    return walk(model, int(model.left[node] if x[f] <= model.cut[node] else model.right[node]), x)


def test_flat_arrays_against_a_plain_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = Q.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.judged(docs, model).collect():
        x = Q.features({c: np.array([r[c]]) for c in Q.COUNTS})[0]
        score = 1 / (1 + np.exp(-(model.bias + sum(walk(model, int(root), x) for root in model.roots))))
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert abs(score - r.score) < 1e-9 and r.kept == (not r.base_failed and score >= Q.THRESHOLD)


def test_labels_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"{'good words here ' * 5} {i} {k}" if i % 2 else "# # #") for i in range(60) for k in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen, fit = [], Q.fit
    Q.fit = lambda x, y, signs: seen.append(len(y)) or fit(x, y, signs)
    try:
        assert Q.train(docs, labels, max_labels=25) is not None
    finally:
        Q.fit = fit
    assert seen == [25]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op1_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.train(docs, labels.where("doc_id % 2 = 0"))
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = [(held[r.doc_id], r.score >= 0.5) for r in Q.judged(docs, model).collect() if r.doc_id in held]
    assert np.mean([bool(a) == b for a, b in got]) > 0.95


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    l = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.train(d, l) is None
    assert Q.judged(d, None).count() == 0
