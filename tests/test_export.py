"""Splitter, parser, runs, sink and command line."""

import json
import os
from datetime import UTC, datetime

import pytest

from skeinlake import cli
from skeinlake.functions import patterns as P
from skeinlake.plans import run
from skeinlake.sinks import JsonArraySink
from skeinlake.sources import export
from skeinlake.sources.export import InputError, ItemError, canonical, split


def node(parent, *parts, role="user", at=0, **meta):
    return {"parent": parent, "message": {"author": {"role": role}, "create_time": at, "content": {"parts": list(parts)}, "metadata": meta}}


def chat(i, *texts, title="t"):
    return {"id": i, "title": title, "current_node": f"n{len(texts) - 1}", "mapping": {f"n{k}": node(f"n{k - 1}" if k else None, t) for k, t in enumerate(texts)}}


def code(f, *a):
    with pytest.raises((InputError, ItemError)) as e:
        f(*a)
    return getattr(e.value, "code", str(e.value))


def test_split():
    long = json.dumps([{"x": "é" * 70_000}, {"y": [1, {"z": "]}\\\""}]}], ensure_ascii=False).encode()
    assert [json.loads(r) for _, r in split(b"\xef\xbb\xbf \n" + long + b"\n")] == json.loads(long)
    assert list(split(b" [ ] ")) == []
    for bad in (b"{}", b"[{},]", b"[{}", b"[{} {}]", b"[1]", b"[{}] x", b'[{"a":"b]', b"", b"["):
        assert code(lambda: list(split(bad))) == "INVALID_JSON_ARRAY", bad
    assert code(lambda: list(split(bytes.fromhex("5b7b2278223a22c328227d5d")))) == "INVALID_UTF8"
    assert code(lambda: list(split(b'[{"x":"' + "é".encode() * (4 << 20) + b'"}]'))) == "CONVERSATION_TOO_LARGE"
    assert code(lambda: list(split(b'[{"x":[' + b"{}," * 130_000 + b"{}]}]"))) == "INPUT_STRUCTURE_TOO_COMPLEX"
    assert code(lambda: list(split(b'[{"x":' + b"[" * 80 + b"]" * 80 + b"}]"))) == "INPUT_STRUCTURE_TOO_COMPLEX"


def test_what_comes_first_is_told_first(spark):
    late = b',{"x":"\xc3("}]'
    rows = lambda data: [r.run_error for r in export.split_files(spark.createDataFrame([("a", data)], "path string, content binary")).collect()]
    good = json.dumps(chat("a", "x")).encode()
    assert rows(b"[" + good + late) == [None, "INVALID_UTF8"]
    assert rows(b'[{"id":"x"}' + late) == ["INPUT_NOT_CHATGPT_EXPORT"]
    assert rows(b"[" + good + b" 5" + late) == [None, "INVALID_JSON_ARRAY"]
    assert rows(b"\xff") == ["INVALID_UTF8"]


def test_quick_and_exact_ends_agree():
    import random

    rng = random.Random(6)
    bits = [b"{", b"}", b"[", b"]", b'"', b"\\", b'\\"', b"a", b",", b":", b" ", b'"k"', b"1.5", b"{}"]
    for _ in range(20_000):
        data = b"{" + b"".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert _outcome(export._item, data) == _outcome(export._long_item, data), data


def _outcome(f, data):
    try:
        return f(data, 0)
    except InputError as e:
        return e.code


def test_canonical():
    tree = {"id": " b1 ", "current_node": "cur", "mapping": {"r": node(None), "q": node("r", "question"), "cur": node("q", "new"), "old": node("q", "old")}}
    c = canonical(tree)
    assert (c["source_id"], c["message_count"], c["sampled"], c["current"]) == ("b1", 2, ["question", "new"], True)
    assert code(canonical, {"id": "x", "current_node": "n", "mapping": {"n": {"parent": 42}}}) == "INVALID_BRANCH"
    assert code(canonical, {"id": "x", "current_node": "a", "mapping": {"a": {"parent": "b"}, "b": {"parent": "a"}}}) == "INVALID_BRANCH"
    assert code(canonical, {"mapping": {}}) == "MISSING_CONVERSATION_ID"
    assert code(canonical, {"conversation_id": "x"}) == "MISSING_MAPPING"
    assert code(canonical, {"id": "x", "mapping": {str(i): {} for i in range(50_001)}}) == "MAPPING_NODE_LIMIT_EXCEEDED"
    empty = canonical({"id": "e", "mapping": {}})
    assert (empty["title"], empty["available"], empty["current"]) == (P.UNTITLED, False, False)
    fallback = canonical({"id": "f", "current_node": "gone", "mapping": {"b": node(None, "2nd", at=2), "10": node(None, "3rd", at=2), "2": node(None, "1st"), "a": node(None, "4th", at=2)}})
    assert fallback["sampled"] == ["1st", "3rd", "2nd", "4th"]
    hidden = canonical({"id": "h", "mapping": {"a": node(None, "s", role="system"), "b": node(None, "h", role="assistant", hidden=True)}})
    assert (hidden["sampled"], hidden["message_count"], hidden["available"]) == ([], 2, False)
    many = canonical(chat("m", *[f"t{i}" for i in range(8)]))
    assert many["sampled"] == ["t0", "t1", "t2", "t5", "t6", "t7"]
    big = canonical(chat("l", "x" * 20_000 + "😀" * 10_000))
    assert big["truncated"] and len(export.units(big["sampled"][0])) // 2 == P.MAX_CHARACTERS + 21
    files = canonical({"id": "a", "mapping": {"n": node(None, "t", {"filename": " f ", "body": "no"}, "u", attachments=[{"mimeType": "m", "name": 1}])}})
    assert files["messages"] == [{"text": "tu\nattachment.filename:f\nattachment.mimeType:m", "parts": ["t", "u", "attachment.filename:f", "attachment.mimeType:m"]}]
    assert [export.timestamp(x) for x in (1700000000.5, 1700000000500, "2024-01-01T00:00:00Z", "x", None, True)] == ["2023-11-14T22:13:20.500Z"] * 2 + ["2024-01-01T00:00:00.000Z", None, None, None]


def save(path, items):
    path.write_text(items if isinstance(items, str) else json.dumps(items, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_run(spark, tmp_path):
    key = "sk-" + "Ab3_" * 6
    good = chat("a", "hi", "测试已完成", title="开发 TypeScript 测试")
    items = [good, chat("b", "1", "2", "3", f"typescript {key}", "5", "6", "7"), {**good, "title": "password=x1"}, chat("c", "password=typescript"), {"id": "d", "mapping": {}}, {"id": "e", "current_node": "n", "mapping": {"n": {"parent": 42}}}, chat("f", "x" * 20_000 + f" {key} " + "y" * 20_000), chat("g", "联系 alice@example.com")]
    text = json.dumps(items, ensure_ascii=False)[:-1] + ',{"id":"broken",}]'
    events = []
    r = run.curate_file(spark, save(tmp_path / "conversations.json", text), datetime(2026, 1, 1, tzinfo=UTC), on_event=events.append)
    assert r.summary == {"totalItems": 9, "classified": 6, "duplicates": 1, "failed": 2, "currentBranchParsed": 5, "branchFallbacks": 1, "contentUnavailable": 1, "classificationTruncated": 1, "s3": 4, "s3Candidates": 0, "suggestedAccept": 1, "requiresReview": 5}
    out = [json.loads(e) for e in events]
    assert [e["type"] for e in out] == ["header", *["conversation"] * 4, "failure", *["conversation"] * 2, "failure", "summary"]
    assert [e["data"]["code"] for e in out if e["type"] == "failure"] == ["INVALID_BRANCH", "INVALID_ITEM_JSON"]
    first = out[1]["data"]["classification"]
    assert (first["primaryCategoryId"], first["lifecycleStatus"], first["requiresReview"], first["reasonCodes"]) == ("software-development", "completed", False, ["UNKNOWN_PROJECT"])
    assert [e["data"]["classification"]["primaryCategoryId"] for e in out[2:4]] == ["other", "other"]
    assert out[2]["data"]["security"]["matchCounts"] == {"API_KEY": 1}
    assert "EMPTY_CONTENT" in out[4]["data"]["classification"]["reasonCodes"] and "CONTENT_TRUNCATED" in out[6]["data"]["classification"]["reasonCodes"]
    assert all(s not in "".join(events) for s in (key, "typescript", "alice", "x" * 50, '"b"'))
    assert [x.json for x in r.events.collect()] == events  # as long as the report isn't closed
    r.close()
    assert out[0]["source"]["sizeBytes"] == len(text.encode()) and out[0]["generatedAt"] == "2026-01-01T00:00:00.000Z"


def test_run_errors(spark, tmp_path):
    go = lambda name, text: code(run.curate_file, spark, save(tmp_path / name, text))
    assert go("a.txt", "[]") == "INVALID_FILE_TYPE"
    assert go("b.json", "") == "INPUT_EMPTY"
    assert go("c.json", "{}") == "INPUT_NOT_CHATGPT_EXPORT"
    assert go("d.json", '[{"id":"x"}]') == "INPUT_NOT_CHATGPT_EXPORT"
    assert go("e.json", [chat("a", "x"), 5]) == "INVALID_JSON_ARRAY"
    assert code(run.curate_file, spark, str(tmp_path / "none.json")) == "INPUT_NOT_READABLE"
    os.mkdir(tmp_path / "f.json")
    assert code(run.curate_file, spark, str(tmp_path / "f.json")) == "INPUT_NOT_FILE"
    empty = run.curate_file(spark, save(tmp_path / "g.json", "[]"))
    assert set(empty.summary.values()) == {0}


def test_item_limit(spark):
    rows = lambda n: export.split_files(spark.createDataFrame([("a", b"[" + b",".join([b'{"id":"x","mapping":{}}'] * n) + b"]")], "path string, content binary")).groupBy("run_error").count().collect()
    assert {r.run_error: r["count"] for r in rows(P.MAX_ITEMS)} == {None: P.MAX_ITEMS}
    assert {r.run_error: r["count"] for r in rows(P.MAX_ITEMS + 1)} == {None: P.MAX_ITEMS, "CONVERSATION_LIMIT_EXCEEDED": 1}


def test_what_a_killed_driver_left_goes(spark, tmp_path):
    gone = next(n for n in range(4_000_000, 4_100_000) if not run.alive(n))
    (tmp_path / f"{run.FOLDER}{gone}-x").mkdir()
    (tmp_path / f"{run.FOLDER}{os.getpid()}-x").mkdir()
    name = "00000000-0000-4000-8000-000000000000"
    (tmp_path / f".o.json.{gone}.{name}.tmp").write_text("[")
    (tmp_path / f".o.json.{os.getpid()}.{name}.tmp").write_text("[")
    source = save(tmp_path / "in.json", [chat("a", "hi")])
    run.curate_file(spark, source, root=str(tmp_path)).close()
    JsonArraySink(str(tmp_path / "o.json"), source).abort()
    assert sorted(p.name for p in tmp_path.iterdir()) == [f".o.json.{os.getpid()}.{name}.tmp", "in.json", f"{run.FOLDER}{os.getpid()}-x"]


def test_interrupts(spark, tmp_path):
    source = save(tmp_path / "in.json", [chat("a", "hi")])

    def stop(_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run.curate_file(spark, source, root=str(tmp_path), on_event=stop)
    sink = JsonArraySink(str(tmp_path / "o.json"), source)
    with pytest.raises(KeyboardInterrupt):
        sink.commit(lambda: True)
    sink.abort()
    assert [p.name for p in tmp_path.iterdir()] == ["in.json"]


def test_sink(tmp_path):
    source = save(tmp_path / "in.json", "[]")
    out = str(tmp_path / "out.json")
    assert code(JsonArraySink, str(tmp_path / "o.txt"), source) == "INVALID_OUTPUT_TYPE"
    assert code(JsonArraySink, str(tmp_path / "no/o.json"), source) == "OUTPUT_DIRECTORY_INVALID"
    assert code(JsonArraySink, source, source, True) == "OUTPUT_OVERWRITES_SOURCE"
    os.link(source, tmp_path / "same.json")
    assert code(JsonArraySink, str(tmp_path / "same.json"), source, True) == "OUTPUT_OVERWRITES_SOURCE"
    s = JsonArraySink(out, source)
    s.write('{"a":1}')
    s.write('{"b":2}')
    assert not os.path.exists(out)
    s.commit()
    assert json.load(open(out)) == [{"a": 1}, {"b": 2}]
    assert code(s.write, "{}") == "OUTPUT_SINK_CLOSED"
    assert code(JsonArraySink, out, source) == "OUTPUT_EXISTS"
    late = JsonArraySink(str(tmp_path / "late.json"), source)
    save(tmp_path / "late.json", "other")
    assert code(late.commit) == "OUTPUT_EXISTS"
    late.abort()
    JsonArraySink(out, source, True).abort()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in.json", "late.json", "out.json", "same.json"]


def test_cli(spark, tmp_path, capsys):
    source = save(tmp_path / "conversations.json", [chat("a", "hi")])
    go = lambda *a: cli.main(list(a), lambda: spark)
    assert go("--help") == 0
    for args, error in ((["--input"], "INPUT_VALUE_REQUIRED"), (["--x"], "UNKNOWN_ARGUMENT"), ([], "INPUT_REQUIRED"), (["--input", "a", "--write"], "OUTPUT_REQUIRED"), (["--input", "a", "--output", "b"], "WRITE_CONFIRMATION_REQUIRED"), (["--input", "a", "--force"], "FORCE_WITHOUT_WRITE"), (["--input", "a", "--output", "--write"], "OUTPUT_VALUE_REQUIRED")):
        assert go(*args) == 1
        assert error in capsys.readouterr().err
    assert go("--input", source, "--write", "--output", str(tmp_path / "r.json")) == 0
    assert [e["type"] for e in json.loads((tmp_path / "r.json").read_text())] == ["header", "conversation", "summary"]
    assert go("--input", save(tmp_path / "dup.json", [chat("a", "x"), chat("a", "y")]), "--summary-only") == 2
    assert "totalItems: 2" in capsys.readouterr().out
    assert run.check_compatibility(spark, str(tmp_path / "none.json")) == "PRIVATE_SAMPLE_MISSING"
    assert run.check_compatibility(spark, source) is None
    assert run.check_compatibility(spark, str(tmp_path / "dup.json")) == "PRIVATE_SAMPLE_DUPLICATE_IDS"
