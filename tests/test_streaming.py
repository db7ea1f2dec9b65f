import json

from skeinlake.streaming import exports as S
from test_export import chat, save


def test_arrivals_and_counters(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    save(folder / "a.json", [chat("x", "hi"), chat("y", "password=q")])
    rows = S.first_arrivals(S.canonical(spark, f"file://{folder}")).select("source_id")
    q = rows.writeStream.format("memory").queryName("arrivals").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    got = []
    counters = S.counted(S.canonical(spark, f"file://{folder}"), lambda n, c: got.append(c), f"file://{tmp_path}/seen").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        q.processAllAvailable()
        counters.processAllAvailable()
        save(folder / "b.json", [chat("y", "again"), chat("z", "new")])
        q.processAllAvailable()
        counters.processAllAvailable()
        assert sorted(r.source_id for r in spark.table("arrivals").collect()) == ["x", "y", "z"]
        assert [(c["totalItems"], c["classified"], c["duplicates"], c["s3"]) for c in got] == [(2, 2, 0, 1), (2, 1, 1, 0)]
    finally:
        q.stop()
        counters.stop()
    assert json.loads((folder / "a.json").read_text())


def test_files_that_end_a_run_are_told(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    save(folder / "a.json", [chat("x", "hi")])
    (folder / "b.json").write_text("[{]")
    q = S.failed_files(spark, f"file://{folder}").writeStream.format("memory").queryName("failed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert [(r.path.rsplit("/")[-1], r.code) for r in spark.table("failed").collect()] == [("b.json", "INPUT_NOT_CHATGPT_EXPORT")]
    finally:
        q.stop()
