import hashlib
import random
import re

import numpy as np
import pytest

from skeinlake.llm import substring_dedup as S


def brute(docs, n=S.WINDOW):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    key = lambda i: S.LAST if i is None else i
    least = {}
    for (i, _), w in zip(docs, words):
        for j in range(len(w) - n + 1):
            x = tuple(w[j : j + n])
            least[x] = min(key(i), least.get(x, S.LAST))
    out = []
    for (i, _), w in zip(docs, words):
        gone = {k for j in range(len(w) - n + 1) if least[tuple(w[j : j + n])] < key(i) for k in range(j, j + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def make(rng, n):
    pool = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.choice([5, 13, 14, 40, 90]))) for _ in range(30)]
    texts = [None, "", "x", "a " * 40, "a " * 12]
    for _ in range(n):
        texts.append(" ".join(rng.choice([pool[rng.randrange(30)], pool[rng.randrange(30)], "é%d \n" % rng.randrange(9), "z"]) for _ in range(rng.choice([1, 3, 12]))))
    docs = list(enumerate(texts)) + [(7, texts[7]), (7, texts[9]), (None, texts[12]), (None, texts[13]), (10**12, texts[14])]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    docs = make(random.Random(9), 150)
    want = brute(docs)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, ord string")
    for parts, how in ((1, {}), (7, {"own_bytes": 4000, "block_bytes": 3000})):
        got = S.deduplicated(df.repartition(parts), **how).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in got) == want
    by = {(r.doc_id): re.findall(r"[^\x20\x09-\x0D]+", t or "") for r in got for i, t in docs if i == r.doc_id and i not in (7, None)}
    for r in got:
        for f in r.factors if r.doc_id in by else ():
            if f.source in by:
                assert f.source < r.doc_id
                assert by[r.doc_id][f.start : f.start + f.words] == by[f.source][f.source_start : f.source_start + f.words]


def greedy(stretches):
    """Factors of each stretch (document, windows): at each place the longest match with a smaller document, by trying all."""
    out, at = [], np.cumsum([0, *(len(w) for _, w in stretches)]).tolist()
    for k, (d, w) in enumerate(stretches):
        i = 0
        while i < len(w):
            best = (0, 0, 0)
            for m, (e, v) in enumerate(stretches):
                for j in range(len(v)) if e < d else ():
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    best = max(best, (n, -e, -(at[m] + j)))
            if best[0]:
                out.append((at[k] + i, best[0], -best[2]))
            i += max(1, best[0])
    return out


@pytest.mark.parametrize("rounds", [S.ROUNDS, 0])
def test_parse_is_greedy_and_longest(rounds, monkeypatch):
    monkeypatch.setattr(S, "ROUNDS", rounds)
    monkeypatch.setattr(S, "CHASED", 5)
    rng = random.Random(3)
    for _ in range(150):
        kinds = rng.choice([1, 2, 3, 12])
        stretches = [(rng.randrange(6), [rng.randrange(kinds) for _ in range(rng.randrange(1, 14))]) for _ in range(rng.randrange(1, 10))]
        token = np.array([x for _, w in stretches for x in w], np.uint64)
        order = np.array([d for d, w in stretches for _ in w])
        new = np.array([i == 0 for _, w in stretches for i in range(len(w))])
        assert list(zip(*(x.tolist() for x in S.Index(token, order, new).parse()))) == greedy(stretches)


def test_long_texts_of_few_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(9000)), "a " * 30_000, " ".join(rng.choice("ab") for _ in range(5000))]
    docs = list(enumerate(texts))
    got = S.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in got) == brute(docs)


def test_empty(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
