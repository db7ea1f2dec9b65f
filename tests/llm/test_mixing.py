import random
import re
from collections import defaultdict

import duckdb
import pytest

from skeinlake.llm import mixing as M


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "Z", None]), rng.choice([None, "", "x y", "w " * rng.randint(1, 60), "# " * 20])) for i in range(900)]
    rows += [(None, "b", "q r s"), (7, "b", "other"), (901, "empty", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, target string")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, M.mix(df.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    sizes, took = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    for r in got:
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(want[r.source]))
        assert r.taken in (0, r["size"], 2 * r["size"])
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= 30, s


def test_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
    df = M.op4_source_mixing(spark, "/root/testdata/sf0.01")
    want = con.sql(M.OP4_SQL)
    assert df.columns == want.columns
    rounded = lambda rows: sorted((*r[:3], round(r[3], 6), r[4]) for r in rows)
    assert rounded(df.collect()) == rounded(want.fetchall())


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_repeated_rows_are_cut_one_by_one(spark):
    rows = [(1, "a", "w " * 10)] * 60 + [(i, "a", "x " * 8) for i in range(2, 52)] + [(i, "b", "y " * 7 + str(i)) for i in range(100, 103)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for shift in range(3):
        got = M.mix(d.selectExpr(f"doc_id + {shift} AS doc_id", "source", "text")).collect()
        assert len(got) == len(rows)
        for s in "ab":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)


def test_given_weights(spark):
    d = spark.createDataFrame([(i, "a", "w " * 5, 9.0 if i % 2 else 0.1) for i in range(400)], "doc_id long, source string, text string, quality double")
    got = M.mix(d, d["quality"], share=0.5, cap=0.5).where("taken > 0").collect()
    assert 190 <= len(got) <= 210 and sum(r.doc_id % 2 for r in got) > 0.9 * len(got)
