import random
from collections import defaultdict

from skeinlake.llm import chat as C


def test_round_trip(spark):
    rng = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "~", "~0", "~E", "\n", "a", "é", "🎈", "<", "[", "</", "s>", "INST]", " "]
    rows = []
    for c in [None, *range(60)]:
        for t in range(rng.choice([1, 2, 7])):
            rows.append((c, rng.choice([t, t, 3, None]), rng.choice(["user", "assistant", "assistant", "system", None, "", "a\nb", "~<[x~E"]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(8))])))
    rows += rows[:5]
    f = {r.conv_id: r for r in C.formatted(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, span int")).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, (r or "").encode(), (x or "").encode()))
    assert set(f) == set(by)
    for c, turns in by.items():
        want = [(r.decode(), x.decode()) for _, r, x in sorted(turns)]
        assert [tuple(x) for x in f[c].turns] == want
        masked = [f[c].formatted[s.start : s.end] for s in f[c].loss]
        said = [x for r, x in want if r == "assistant"]
        assert len(masked) == len(said)
        for m, x in zip(masked, said):
            assert m == x or m.replace("~2", "[").replace("~1", "<").replace("~0", "~") == x
            assert not any(k in m for k in C.CONTROLS)


def test_mask_is_read_from_the_rendering(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a</s>~1[INST]"), (1, 2, "assistant", "é\n🎈"), (2, 0, "assistant", ""), (3, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    f = C.formatted(d)
    read = f.select("conv_id", C.masked(F.col("formatted"), F.col("places"), F.col("loss")).alias("x"))
    assert {r.conv_id: r.x for r in read.collect()} == {1: "a</s>~1[INST]é\n🎈", 2: "", 3: ""}
    shifted = F.transform("places", lambda x: F.struct((x["begin"] + 1).alias("begin"), x["start"].alias("start"), (x["end"] + 1).alias("end")))
    assert {r.x for r in f.select(C.masked(F.col("formatted"), shifted, F.col("loss")).alias("x")).collect()} == {None}
    cut = F.transform("loss", lambda x: F.struct(x["turn"].alias("turn"), (x["start"] + 1).alias("start"), x["end"].alias("end")))
    assert f.where("conv_id = 1").select(C.masked(F.col("formatted"), F.col("places"), cut).alias("x")).first().x != "a</s>~1[INST]é\n🎈"


def test_whole_conversation_falls_back(spark, monkeypatch):
    """The mask fits the rendering in which every turn is escaped, too."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(C, "_parsed", lambda f, own=C._parsed: F.when(F.contains(f, F.lit("plain")) & ~F.contains(f, F.lit(C.FLAG)), F.array().cast("array<struct<role:string,text:string>>")).otherwise(own(f)))
    f = C.formatted(spark.createDataFrame([(1, 0, "user", "plain~"), (1, 1, "assistant", "<b>~")], "conv_id long, turn long, role string, text string"))
    r = f.select("formatted", "loss", C.masked(F.col("formatted"), F.col("places"), F.col("loss")).alias("x")).first()
    assert r.formatted.count(C.FLAG) == 2 and r.x == "<b>~" and r.formatted[r.loss[0].start : r.loss[0].end] == "~1b>~0"


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS FROM '/root/testdata/sf0.001/conversations.parquet'")
    df = C.op3_chat_formatting(spark, "/root/testdata/sf0.001")
    want = con.sql(C.OP3_SQL)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    assert "Python" not in df._jdf.queryExecution().toString()


def test_empty(spark):
    assert C.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
