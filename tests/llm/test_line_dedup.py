import random
import re

from skeinlake.llm import line_dedup as L


def rising(places):
    """Indexes of a longest increasing subsequence, by dynamic programming; of equally long ones that whose ends are least."""
    tops = []  # for each length, the index at which a sequence of that length ends with the least value
    before = {}
    for i, v in enumerate(places):
        k = sum(places[t] < v for t in tops)
        before[i] = tops[k - 1] if k else None
        tops[k : k + 1] = [i]
    out, i = [], tops[-1] if tops else None
    while i is not None:
        out.insert(0, i)
        i = before[i]
    return out


def diff(a, b):
    """Patience diff by recursion: equal ends, then lines that are unique in both, then the ranges between."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    found = {(i, i) for i in range(head)} | {(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)}
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    unique = [(x.index(v), j) for j, v in enumerate(y) if x.count(v) == 1 == y.count(v)]
    anchors = [unique[k] for k in rising([i for i, _ in unique])]
    if anchors:
        i0 = j0 = 0
        for i, j in [*anchors, (len(x), len(y))]:
            found |= {(p + head + i0, q + head + j0) for p, q in diff(x[i0:i], y[j0:j])}
            i0, j0 = i + 1, j + 1
        found |= {(i + head, j + head) for i, j in anchors}
    return found


def shared(a, b, words):
    """Places in b of the common blocks of at least BLOCK_WORDS words."""
    pairs, out = diff(a, b), set()
    for i, j in pairs:
        if (i - 1, j - 1) not in pairs:
            run = []
            while (i, j) in pairs:
                run.append(j)
                i, j = i + 1, j + 1
            if sum(words[k] for k in run) >= L.BLOCK_WORDS:
                out.update(run)
    return out


def brute(docs):
    """Every document against every earlier one, on the lines themselves and without a function of the operator."""
    n_words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    keys = sorted({(L.LAST if i is None else i, t) for i, t in docs if t is not None})
    out = {}
    for at, k in enumerate(keys):
        lines = k[1].split("\n")
        full = [n for n, x in enumerate(lines) if x]
        b = [lines[n] for n in full]
        gone = {full[j] for earlier in keys[:at] for j in shared([x for x in earlier[1].split("\n") if x], b, [n_words(x) for x in b])}
        out[k] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_clean(spark):
    rng = random.Random(6)
    pool = ["a b c d e f", "one two three", "g h", "", " ", "é ü ö x y", "\t\r", *["line %d of the pool" % i for i in range(25)]]
    texts = [None, "", "\n\n", *["\n".join(rng.choice(pool) for _ in range(rng.choice([1, 5, 30]))) for _ in range(70)], "\n".join(pool * 40)]
    docs = list(enumerate(texts)) + [(5, texts[5]), (5, texts[9]), (None, texts[10])]
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, n_lines string")
    want = brute(docs)
    got = L.cleaned(df)
    assert got.columns == df.columns
    plain = sorted((str(i), str(None if t is None else want[(L.LAST if i is None else i, t)]), "n") for i, t in docs)
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in got.collect()) == plain


def test_lost_pairs(spark):
    """Two documents share a block whose lines an earlier document holds apart; two share lines that each occur twice."""
    lines = ["alpha beta gamma", "one two three"]
    twice = "\n".join(["u1 u2 u3", "v1 v2 v3", "u1 u2 u3", "v1 v2 v3"])
    docs = [(1, f"{lines[0]}\nbetween\n{lines[1]}"), (2, "\n".join(["p", *lines])), (3, "\n".join(["q", *lines])), (4, f"r\n{twice}"), (5, f"s\n{twice}")]
    got = {r.doc_id: r.text for r in L.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: t for (i, _), t in brute(docs).items()} and (got[3], got[5]) == ("q", "s")


def test_recall_of_links(spark):
    """Generated documents, a third of them with one common block: no line that any pair would delete stays."""
    rng = random.Random(31)
    word = lambda: "w%d" % rng.randrange(400)
    line = lambda: " ".join(word() for _ in range(rng.choice([1, 2, 4, 8])))
    blocks = [[line() for _ in range(rng.choice([1, 3, 6]))] for _ in range(25)]
    docs = []
    for i in range(150):
        parts = [*rng.sample(blocks, rng.choice([0, 1, 2])), [line() for _ in range(rng.randrange(1, 6))], *([blocks[0]] if i % 3 == 0 else [])]
        rng.shuffle(parts)
        docs.append((i, "\n".join(x for p in parts for x in p)))
    got = {(r.doc_id, r.text) for r in L.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(i, t) for (i, _), t in brute(docs).items()}


def test_least_words(spark):
    passage = "a passage of over five words"
    docs = [(1, passage), (2, passage), (3, f"{passage}\nleft"), (4, f"{passage}\nsome words are left"), (5, "short"), (6, None), (7, "")]
    got = L.cleaned(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, lines int"), least_words=3)
    assert got.columns == ["doc_id", "text", "lines"]
    assert {r.doc_id: r.text for r in got.collect()} == {1: passage, 4: "some words are left", 5: "short", 6: None, 7: ""}


def test_query(spark):
    import hashlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: hashlib.sha256(t.encode()).hexdigest() for (i, _), t in brute(docs).items()}
    got = {r.doc_id: r.kept_sha256 for r in L.op10_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert {i: got[i] for i in want} == want and len(got) == len(docs)


def test_patience():
    assert L.patience([1, 2, 3, 9, 4], [7, 2, 3, 4]) == [(1, 1), (2, 2), (4, 3)]
    rng = random.Random(0)
    for _ in range(300):
        a, b = [[rng.randrange(9) for _ in range(rng.randrange(14))] for _ in "ab"]
        p = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in p)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
        assert L.patience(a, a) == [(i, i) for i in range(len(a))]


def test_empty(spark):
    assert L.cleaned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
