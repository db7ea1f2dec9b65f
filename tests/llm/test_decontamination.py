import random

from skeinlake.llm import decontamination as D


def test_matches_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "cé", "d1", "the"])
    sep = lambda: rng.choice([" ", ", ", "\n"])
    text = lambda n: "".join(word() + sep() for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25])) if i % 7 else rng.choice([None, "", "!!"])) for i in range(25)]
    items += [(3, items[3][1]), (40, "solo"), (41, " ".join("w%d" % i for i in range(30)))]
    docs = [(i, text(rng.choice([0, 1, 5, 40, 200]))) for i in range(60)] + [(60, None), (61, ""), (62, "x SOLO y"), (62, "x SOLO y"), (63, "q " * 3000 + " ".join("W%d" % i for i in range(5, 20)))]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 30):
        got = D.matches(d, b, block_words=block).collect()
        import hashlib
        have = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got)
        assert have == sorted(D.brute(docs, items))
    long = next(r for r in got if r.doc_id == 63)
    assert (long.longest, long.longest_item, long.longest_at) == (15, 41, 3000)
    clean = D.decontaminate(d, b)
    assert clean.columns == d.columns
    assert sorted(map(tuple, D.decontaminate(d, b, block_words=30).collect()), key=str) == sorted(map(tuple, clean.collect()), key=str)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in D.brute(docs, items) if not x[5])


def longest(words, items):
    """Words and first word of the longest common run of at least a window (or of a whole shorter item), by trying all."""
    best = (0, 0)
    for w in items:
        for i in range(len(words)):
            for j in range(len(w)):
                n = 0
                while i + n < len(words) and j + n < len(w) and words[i + n] == w[j + n]:
                    n += 1
                if n >= min(10, len(w)) and n and (len(w) >= 10 or n == len(w)):
                    best = max(best, (n, -i))
    return best[0], -best[1]


def test_longest_matches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "PAIRS", 7)
    rng = random.Random(12)
    for kinds in (1, 2, 3, 6, 70_000):
        for _ in range(12):
            text = lambda n: " ".join("w%d" % rng.randrange(kinds) for _ in range(n))
            items = [text(rng.choice([1, 4, 10, 12, 30])) for _ in range(6)]
            texts = [text(rng.choice([0, 3, 40, 90])) for _ in range(6)] + [f"x y {items[0]} {items[1]}"]
            _, _, _, best = D.judge(pa.array(texts), D.index_block(list(range(6)), items))
            for r, t in enumerate(texts):
                assert best.get(r, (0, 0, None))[:2] == longest(t.split(), [i.split() for i in items]), (t, items)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, D.op5_decontamination(spark, sf).collect())) == sorted(D.brute(docs, items))


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(d, b).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.n_hit for r in D.matches(one, b).collect()] == [0]
