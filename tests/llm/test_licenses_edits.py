from skeinlake.llm import licenses as L


def test_edits_that_still_verify(spark):
    mit = next(words for _, label, words, phrase in L._templates() if label == "mit" and len(words) > 20)
    replaced = [f"other{i}" if i in (1, 7, 13, 19, 25) else w for i, w in enumerate(mit)]
    inserted = mit[:14] + ["some", "words", "put", "in"] + mit[14:]
    ends = [f"other{i}" if i in (1, 27) else w for i, w in enumerate(mit)]
    too_many = [f"other{i}" if i % 4 == 1 else w for i, w in enumerate(mit)]
    docs = [(i, " ".join(["a"] * 9 + t + ["b"] * 9)) for i, t in enumerate([replaced, inserted, ends, too_many])]
    got = {r.doc_id: [round(s.score * len(mit)) for s in r.spans if s.label == "mit"] for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: [24], 1: [29], 2: [27], 3: []}
