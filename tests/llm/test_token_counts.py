import random

import public_tokenizers as P

from skeinlake.llm import token_counts as C

PATH, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def whole(text):
    return len(C.exact(PATH).encode(text, add_special_tokens=False))


def test_everyday_characters():
    spans = [(0, 0x4FF), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    quick = C.quick(RANKS)
    for low, high in spans:
        for c in map(chr, range(low, high + 1)):
            text = f"a{c}b {c}1 {c}{c} \n{c}"
            assert len(quick.encode_ordinary(text)) == whole(text), hex(ord(c))


def test_chunks():
    rng = random.Random(3)
    bits = ["the", " ", "  ", "\n", "é", "日本", "<|endoftext|>", "<|endof", "text|>", "'s", "'", "12", "xxxxxxxxxxxxxxxx", "!!", " ", "🎈", "ᾟ", "a" * 90, " " * 70]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([5, 50, 200])))
        assert C.count_chunked(C.exact(PATH), text, 64, 8) == whole(text)
    text = "ab" * 5000 + " x"
    assert C.count_chunked(C.exact(PATH), text, 64, 8) == whole(text)


def test_frame(spark):
    texts = [None, "", "a b", "<|endoftext|>x", "word " * 20000, "🎈" * 50, "ß" * 9]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, "a b", 1)], "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r) for r in C.token_counts(d, PATH, RANKS).collect())
    assert got == sorted((i, len((t or "").encode()), whole(t or "")) for i, t in [*enumerate(texts), (2, "a b")])


def test_quick_path_on_whole_texts(spark):
    """Whole documents, and random mixtures of everyday characters, count alike in both libraries."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    rng = random.Random(9)
    kinds = ["abcdefghijkl", "ABCXYZ", "0123456789", " ", "  \n\t\r", "'\"-_.,;:!?/()[]{}", "éüßñçøå", "жяю", "漢字仮名", "かなカナ", "한글", "\u2014\u2019\u2026", "'s're'll", "\u00a0\u0085\u000b"]
    texts += ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([3, 30, 300]))) for _ in range(20_000)]
    texts.append("".join(rng.choice(rng.choice(kinds)) for _ in range(3 * C.CHUNK)))
    assert C.counts(texts, PATH, RANKS) == [whole(t) for t in texts]
    assert sum(not C._OTHER.search(t) for t in texts) > 15_000


def test_empty_and_query(spark):
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, RANKS).count() == 0
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in C.op8_token_counts(spark, sf).collect())
    assert got == sorted((r.doc_id, len((r.text or "").encode()), n, n > 512) for r in docs for n in [whole(r.text or "")])
