import random
import re

from skeinlake.llm import licenses as L

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_scan(spark):
    rng = random.Random(8)
    bits = ["under the MIT license", "Under, the", "mit", "license", "Apache License, Version 2", "cc by-nc", "cc", "by nc", "é", "x9", *[t for _, t in L.TEMPLATES]]
    texts = [None, "", "cc", "cc by nc", "CC BY-NC cc by nc", "under the mit license " * 300]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.choice([1, 4, 30]))) for _ in range(80)]
    gpl = next(t for n, t in L.TEMPLATES if n == "gpl-3" and len(t) > 100).split()
    texts += [" ".join(["a"] * 50 + gpl[:10] + ["and", "so"] + gpl[10:] + ["b"])]
    docs = [(i, t, 1) for i, t in enumerate(texts)] + [(3, "cc by nc", 1), (3, "other", 1), (None, "cc by nc", 1), (None, None, 1)]
    got = L.scan(spark.createDataFrame(docs, "doc_id long, text string, n_words int")).collect()
    assert len(got) == len(docs)
    want = []
    for i, t, _ in docs:
        w = words(t)
        places = sorted((j, label) for label, p in L.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        want.append((str(i), len(w), str(places)))
    assert sorted((str(r.doc_id), r.n_words, str(sorted((s.first, s.label) for s in r.spans if s.phrase))) for r in got) == sorted(want)
    by = {r.doc_id: r for r in got}
    edited = [s for s in by[len(texts) - 1].spans if s.label == "gpl-3"]
    assert len(edited) == 1 and edited[0].first == 50 and edited[0].score == 1.0
    each = spark.createDataFrame([(n, "q " + t + " z") for n, (_, t) in enumerate(L.TEMPLATES)], "doc_id long, text string")
    found = {r.doc_id: {s.label for s in r.spans} for r in L.scan(each).collect()}
    assert all(label in found[n] for n, (label, _) in enumerate(L.TEMPLATES))


def plain_votes(w):
    """template, first and last word and votes of merged diagonals, by trying every place against every place."""
    out = []
    for n, _, t, phrase in L._templates():
        slack, least = L.limits(len(t), phrase)
        grams = lambda x: [tuple(x[i : i + L.K]) for i in range(len(x) - L.K + 1)]
        by = {}
        for i, g in enumerate(grams(w)):
            for j, h in enumerate(grams(t)):
                if g == h:
                    by.setdefault(i - j, set()).add(j)
        run = []
        for d in [*sorted(by), None]:
            if run and (d is None or d - run[-1] > slack):
                votes = sum(len(by[x]) for x in run)
                if votes >= least:
                    out.append((n, min(x + min(by[x]) for x in run), max(x + max(by[x]) for x in run) + L.K, votes))
                run = []
            run.append(d)
    return out


def test_votes_and_labels_against_brute_force(spark):
    """Edited notices in other words: the spans and the labels that verify."""
    rng = random.Random(14)
    docs = []
    for i in range(60):
        t = words(rng.choice(L.TEMPLATES)[1])
        for _ in range(rng.choice([0, 1, 3, 6, 9])):
            k = rng.randrange(len(t))
            t[k : k + rng.choice([0, 1])] = rng.choice([["other"], [], ["two", "more"]])
        docs.append((i, " ".join(["so"] * rng.randrange(5) + t + ["on"] * rng.randrange(5) + rng.choice([[], ["under", "the", "mit", "license"]]))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    votes = sorted((r.doc_id, r.template, r["first"], r["last"], r.votes) for r in L.voted(spark, L._keyed(df)).collect())
    assert votes == sorted((i, *v) for i, t in docs for v in plain_votes(words(t)))
    templates, got = L._templates(), {r.doc_id: sorted({s.label for s in r.spans}) for r in L.scan(df).collect()}
    kept = lambda t, label: max((L.verified_share(words(t), x, False) for _, name, x, p in templates if name == label and not p), default=0)
    assert all(kept(t, label) >= L.VERIFIED or label in {a for a, _ in L.PHRASES} for i, t in docs for label in got[i])
    assert sum(map(bool, got.values())) > 20


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in L.op6_license_scan(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w = words(d.text)
        places = [(j, label) for label, p in L.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((j for j, _ in places), default=None), max((j for j, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r["labels"].split(","))


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
