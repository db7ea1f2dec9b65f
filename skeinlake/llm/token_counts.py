"""Exact token counts of whole texts, huge ones by overlapping chunks.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring
chunks are spliced at a place where both begin a pre-token: the splitting
pattern never looks left of the place it has reached, so from a place that the
left chunk reached rightly and the right chunk reached too, both go on alike.
Places so near to the left chunk's end that a special string might be cut there
don't count. Where no common place is found, the overlap is widened by merging
the right chunk into the left one, to the rest of the text at last.

Texts of everyday characters without special strings are encoded by the quicker
library with the same vocabulary; its counts are equal on the characters in
``EVERYDAY`` (the tests compare every one of them). All others go to the
reference library itself.

Cases: a null text is empty and has no tokens; texts of any length are counted whole;
repeated rows and rows without an id are each counted; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, textcore

CHUNK, OVERLAP = 1 << 16, 1 << 10
LIMIT = 512
EVERYDAY = "\u0000-ӿ‐-‧ぁ-ゖァ-ヺ一-龥가-힣"
_OTHER = re.compile(f"[^{EVERYDAY}]")


@lru_cache(4)
def exact(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(4)
def quick(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class _Chunk:
    """Token starts of text[low:high] as offsets of the whole text, and the places where pre-tokens begin."""

    def __init__(self, tokenizer, text: str, low: int, high: int):
        e = tokenizer.encode(text[low:high], add_special_tokens=False)
        self.low, self.high = low, high
        self.starts = np.array([a for a, _ in e.offsets], np.int64) + low
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        self.places = self.starts[new]
        self.at = np.flatnonzero(new)

    def index(self, place: int) -> int:
        """Number of tokens before a pre-token's place."""
        return int(self.at[np.searchsorted(self.places, place)])


def count_chunked(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of text, encoding at most about ``chunk`` characters at once where places in common are found."""
    margin = max([1, *map(len, special_strings(tokenizer))])
    overlap = max(overlap, 2 * margin + 2)
    chunk = max(chunk, 2 * overlap)
    left, done, total = _Chunk(tokenizer, text, 0, min(chunk, len(text))), 0, 0
    skip = 0  # tokens of left that stand before the splice
    while left.high < len(text):
        low = left.high - overlap
        right = _Chunk(tokenizer, text, low, min(low + chunk, len(text)))
        common = np.intersect1d(left.places[left.places >= done], right.places)
        common = common[common <= left.high - margin]
        if len(common):
            place = int(common[0])
            total += left.index(place) - skip
            left, done, skip = right, place, right.index(place)
        else:
            left, skip = _Chunk(tokenizer, text, done, min(max(right.high, left.high + 2 * (left.high - done)), len(text))), 0
    return total + len(left.starts) - skip


def counts(texts: list[str | None], path: str, ranks: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    tokenizer = exact(path)
    specials = special_strings(tokenizer)
    encode = quick(ranks).encode_ordinary if ranks else None
    out = []
    for text in texts:
        if not text:
            out.append(0)
        elif len(text) > chunk:
            out.append(count_chunked(tokenizer, text, chunk, overlap))
        elif encode is not None and not _OTHER.search(text) and not any(s in text for s in specials):
            out.append(len(encode(text)))
        else:
            out.append(len(tokenizer.encode(text, add_special_tokens=False)))
    return out


def token_counts(docs: DataFrame, path: str, ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row. path: the vocabulary; ranks: the same one for the quicker library."""
    frames.ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                _, offsets = textcore.buffers(part.column("text"))
                yield frames.batch(schema, doc_id=part.column("doc_id"), n_bytes=np.diff(offsets), n_tokens=counts(part.column("text").to_pylist(), path, ranks, chunk, overlap))

    return frames.ids(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts(frames.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
