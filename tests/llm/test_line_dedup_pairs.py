import random
import re

import pyarrow as pa

from skeinlake.llm import line_dedup as L


def every_pair(texts):
    """Every document, in order, against every earlier one, with texts in place of fingerprints."""
    seqs = [[x for x in t.split("\n") if x] for t in texts]
    words = [[len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in s] for s in seqs]
    gone = [{j for a in seqs[:k] for j in L.deleted(a, b, words[k], L.BLOCK_WORDS)} for k, b in enumerate(seqs)]
    return [L.without_lines(t, sorted(g)) for t, g in zip(texts, gone)]


def cleaned(spark, texts):
    got = L.cleaned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r.text for r in got.orderBy("doc_id").collect()]


def test_later_holders(spark):
    """The first holders have two shared lines the other way round: of these patience keeps one."""
    x, y = "one line of five words", "another line of just six words"
    texts = [f"{y}\nq{i}\n{x}" for i in range(12)] + [f"{x}\nown", f"{x}\nz\n{y}"]
    want = every_pair(texts)
    assert want[-1] == "z"
    assert cleaned(spark, texts) == want


def test_repeated_and_short_lines(spark):
    line = "a passage of over five words"
    short = "\n".join(f"w{i}" for i in range(8))
    pasted = "\n".join(["this text stands here", "and was pasted twice"] * 2)
    texts = [f"x\n{line}\ny\n{line}\nz", f"x\n{line}\nu\n{line}\nz", short, f"k\n{short}", pasted, pasted, f"q\n \n{line}\n\t\nw3\nw4\nw5\nw6\nw7", "a b\nc\nd e", "c\na b\nc\nd e\n"]
    want = every_pair(texts)
    assert want[1] == "u" and want[3] == "k" and want[5] == ""
    assert cleaned(spark, texts) == want


def test_random(spark):
    rng = random.Random(11)
    pool = ["a b c d e f", "one two three", "g h", " ", "\t", "i", "j", "four words are here", "k l m n o p q"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.choice([2, 5, 9, 25]))) for _ in range(120)]
    assert cleaned(spark, texts) == every_pair(texts)


def test_collision(monkeypatch):
    """Lines whose first fingerprints are equal are still other lines."""
    monkeypatch.setattr(L, "_lines", lambda texts, real=L._lines: (lambda s, h, n: (s, h * 0, n))(*real(texts)))
    texts = pa.array(["five words are in here", "other words are in here"])
    lines, h, _ = L._lines(texts)
    assert h[0] == h[1]
    a, b = (pa.array([[x]]) for x in h), (pa.array([[x]]) for x in lines.hashes(1).view("int64"))
    x, y = (L.twofold(p, q)[0] for p, q in zip(a, b))
    assert L.deleted(x, x, [5], L.BLOCK_WORDS) == [0] and L.deleted(x, y, [5], L.BLOCK_WORDS) == []
