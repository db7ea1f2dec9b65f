"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is a slice of an Arrow batch. All suffixes of all its documents are sorted, by
the words of the benchmark's vocabulary (another word is smaller than all, like a
document's end) and to the depth of a window at least, which is all that decides a
match. Every suffix of the benchmark items is looked up in it by binary search of its
first ``window`` words; from where a match begins (the words before differ) it is
followed to its end, which gives the longest verbatim matches and their places.

The benchmark is indexed in blocks of about ``block_words`` words, some 80 bytes each.
One block is broadcast at a time and documents are never shuffled; a benchmark of several
blocks takes a pass over the documents for each, stored in between with what was found.

Cases: a null text has no words and is clean; a text or item without words
matches nothing; texts of any length are one shard whole; an item shorter than the
window must occur whole; items without an id mark words but are not listed; repeated
rows and items are judged alike and each row is returned; empty tables of documents or
items give no rows or no hits; other columns never clash, and pass through decontaminate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, textcore

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: Text of a shard, and pairs of a training place and a benchmark place that are looked at together.
SHARD_BYTES, PAIRS = 8 << 20, 1 << 21


@dataclass
class Suffixes:
    """The suffixes of a block's items, cut at ``length`` words: distinct windows in order, as packed words, and where each stands."""

    length: int
    windows: list[np.ndarray]  # column j: the words from j * per on of each window
    of: np.ndarray  # window k stands at place[of[k]:of[k + 1]] of the block, in order of the word before, ``left``
    place: np.ndarray
    left: np.ndarray
    item_of: np.ndarray  # its items, each once: item[item_of[k]:item_of[k + 1]]
    item: np.ndarray


@dataclass
class Block:
    vocabulary: np.ndarray
    bits: int
    ranks: np.ndarray  # of all words of the items; 0 at the end
    row: np.ndarray
    groups: list[Suffixes]
    item_ids: list[int | None]

    @property
    def per(self) -> int:
        """Words in 64 bits."""
        return 64 // self.bits


def _packed(ranks: np.ndarray, room: np.ndarray, bits: int, low: int, n: int) -> np.ndarray:
    """For each place, the words from ``low`` on, n of them, big-endian; 0 behind the text's end."""
    out = np.zeros(len(ranks), np.uint64)
    for j in range(low, low + 64 // bits):
        out <<= np.uint64(bits)
        if low <= j < low + n:
            on = np.flatnonzero(room > j)
            out[on] |= ranks[on + j]
    return out


def _room(row: np.ndarray) -> np.ndarray:
    """For each word, the words from it to the end of its text."""
    ends = np.searchsorted(row, row, "right")
    return ends - np.arange(len(row))


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and where a new one begins in it."""
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    return by, np.flatnonzero(new)


def index_block(item_ids: list[int | None], texts: list[str | None], window: int = WINDOW) -> Block:
    w = textcore.alnum_words(pa.array(texts, pa.string()))
    hashes = w.hashes()
    vocabulary = np.unique(hashes)
    bits = max(1, int(len(vocabulary)).bit_length())
    ranks = (np.searchsorted(vocabulary, hashes) + 1).astype(np.uint64)
    room, sizes = _room(w.row), np.diff(w.bounds())
    before = np.append(np.uint64(0), ranks[:-1])
    before[w.bounds()[:-1][sizes > 0]] = 0
    per, groups = 64 // bits, []
    for length in sorted({min(window, int(n)) for n in sizes if n}):
        own = sizes >= window if length == window else sizes == length
        at = np.flatnonzero(own[w.row] & (room >= length))
        columns = [_packed(ranks, room, bits, j, min(per, length - j))[at] for j in range(0, length, per)]
        by, edge = _distinct([*columns, before[at]])[0], _distinct(columns)[1]
        at, row = at[by], w.row[at[by]]
        window_of = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(by))))
        items = np.unique(window_of * w.rows + row)
        groups.append(Suffixes(length, [c[by][edge] for c in columns], np.append(edge, len(by)), at, before[at], np.searchsorted(items, np.arange(len(edge) + 1) * w.rows), items % w.rows))
    return Block(vocabulary, bits, np.append(ranks, np.uint64(0)), np.append(w.row, -1), groups, item_ids)


class Shard:
    """The suffix array of the words of several texts, in the vocabulary of a block."""

    def __init__(self, block: Block, hashes: np.ndarray, row: np.ndarray, depth: int):
        at = np.searchsorted(block.vocabulary, hashes)
        at[at == len(block.vocabulary)] = 0
        self.ranks = np.where(block.vocabulary[at] == hashes, at + 1, 0).astype(np.uint64)
        self.row, self.room, self.bits, self.per = row, _room(row), block.bits, block.per
        self.known = np.zeros(len(block.vocabulary) + 1, bool)
        self.known[self.ranks] = True
        self.lead = _packed(self.ranks, self.room, self.bits, 0, self.per)
        self.suffixes, sorted_to = np.argsort(self.lead), self.per
        key = self.lead
        while sorted_to < depth:
            rank = np.empty(len(key), np.int64)
            rank[self.suffixes] = np.cumsum(np.append(True, key[self.suffixes][1:] != key[self.suffixes][:-1]))
            ahead = np.zeros(len(key), np.int64)
            on = np.flatnonzero(self.room > sorted_to)
            ahead[on] = rank[on + sorted_to]
            key = rank * (len(key) + 1) + ahead
            self.suffixes, sorted_to = np.argsort(key), 2 * sorted_to
        self.lead = self.lead[self.suffixes]

    def _part(self, suffix: np.ndarray, low: int, n: int) -> np.ndarray:
        """The words from ``low`` on of some suffixes, packed."""
        out = np.zeros(len(suffix), np.uint64)
        for j in range(low, low + self.per):
            out <<= np.uint64(self.bits)
            if j < low + n:
                on = np.flatnonzero(self.room[suffix] > j)
                out[on] |= self.ranks[suffix[on] + j]
        return out

    def find(self, g: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of g that occur, and the range of suffixes that each begins."""
        per, bits, length = self.per, np.uint64(self.bits), g.length
        # a window with a word that isn't in the shard can't be found
        k = np.arange(len(g.windows[0]))
        for j in range(length):
            c = g.windows[j // per][k] >> (bits * np.uint64(per - 1 - j % per))
            k = k[self.known[(c & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]]
        low = g.windows[0][k]
        spare = bits * np.uint64(max(0, per - length))
        low, high = np.searchsorted(self.lead, low, "left"), np.searchsorted(self.lead, low + ((np.uint64(1) << spare) - np.uint64(1)), "right")
        k, low, high = (x[low < high] for x in (k, low, high))
        for c in range(1, len(g.windows)):
            n = min(per, length - c * per)
            want = g.windows[c][k]
            low, high = self._edge(c * per, n, want, low, high, False), self._edge(c * per, n, want, low, high, True)
            k, low, high = (x[low < high] for x in (k, low, high))
        return k, low, high

    def _edge(self, at: int, n: int, want: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while len(on := np.flatnonzero(low < high)):
            middle = (low[on] + high[on]) // 2
            found = self._part(self.suffixes[middle], at, n)
            right = found <= want[on] if after else found < want[on]
            low[on[right]] = middle[right] + 1
            high[on[~right]] = middle[~right]
        return low


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n - low, n), of


def _portions(n: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive numbers whose counts come to about PAIRS."""
    edge = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()) + PAIRS, PAIRS), "left") + 1, 0))
    for a, b in zip(edge, np.append(edge[1:], len(n)), strict=True):
        yield np.arange(a, min(b, len(n)))


def _items(g: Suffixes, rows: int, items: int, row: np.ndarray, window: np.ndarray) -> np.ndarray:
    """row * items + item of the items that texts hold, in order."""
    pairs = np.unique(row * len(g.windows[0]) + window)
    row, window = np.divmod(pairs, len(g.windows[0]))
    out = np.zeros(0, np.int64)
    for part in _portions(g.item_of[window + 1] - g.item_of[window]):
        at, of = _spread(g.item_of[window[part]], g.item_of[window[part] + 1])
        out = np.union1d(out, row[part][of] * items + g.item[at])
    return out


def _longest(block: Block, shard: Shard, g: Suffixes, at: np.ndarray, window: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text, in portions: row, words and first word of matches that go on as far as they can, and the item's place."""
    before = np.where((at > 0) & (shard.row[at] == shard.row[at - 1]), shard.ranks[at - 1], 0)
    begin, end = g.of[window], g.of[window + 1]
    # a match begins where the words before differ, or are not of the benchmark, or there is none
    same = np.flatnonzero(before > 0)
    code = np.repeat(np.arange(len(g.windows[0])), np.diff(g.of)) * (len(block.vocabulary) + 1) + g.left.astype(np.int64)
    want = window[same] * (len(block.vocabulary) + 1) + before[same].astype(np.int64)
    a, b = begin.copy(), begin.copy()
    a[same], b[same] = np.searchsorted(code, want, "left"), np.searchsorted(code, want, "right")
    low, high, hit = np.concatenate((begin, b)), np.concatenate((a, end)), np.tile(np.arange(len(at)), 2)
    for part in _portions(high - low):
        k, of = _spread(low[part], high[part])
        doc, place = at[hit[part][of]], g.place[k]
        size = np.full(len(doc), g.length)
        on = np.arange(len(doc))
        while len(on):
            p, q = doc[on] + size[on], place[on] + size[on]
            inside = (shard.room[doc[on]] > size[on]) & (block.row[q] == block.row[place[on]])
            on = on[inside]
            on = on[shard.ranks[p[inside]] == block.ranks[q[inside]]]
            size[on] += 1
        yield doc, size, place


STATE = pa.schema([("hits", pa.binary()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.int64()), ("longest_at", pa.int64())])


def judge(texts: pa.Array, block: Block) -> tuple[textcore.Spans, np.ndarray, list[list[str]], dict[int, tuple[int, int, int | None]]]:
    """The words of the texts, which are hit, the items of each text and the longest match: words, first word, item."""
    w = textcore.alnum_words(texts)
    hashes, first = w.hashes(), w.bounds()
    hit, best = np.zeros(len(hashes), bool), {}
    found: list[set[str]] = [set() for _ in range(w.rows)]
    if not len(hashes) or not block.groups:
        return w, hit, [[] for _ in found], best
    shard = Shard(block, hashes, w.row, max(g.length for g in block.groups))
    ids = len(block.item_ids)
    for g in block.groups:
        k, low, high = shard.find(g)
        if not len(k):
            continue
        x, of = _spread(low, high)
        at, window = shard.suffixes[x], k[of]
        hit |= textcore.cover(at, g.length, len(hashes))
        for r, i in zip(*(v.tolist() for v in np.divmod(_items(g, w.rows, ids, w.row[at], window), ids)), strict=True):
            if block.item_ids[i] is not None:
                found[r].add(str(block.item_ids[i]))
        for doc, size, place in _longest(block, shard, g, at, window):
            by = np.lexsort((block.row[place], doc, -size, w.row[doc]))
            rows, one = np.unique(w.row[doc][by], return_index=True)
            for r, j in zip(rows.tolist(), by[one].tolist(), strict=True):
                best[r] = max(best.get(r, (0, 0, None)), (int(size[j]), -int(doc[j] - first[r]), block.item_ids[block.row[place[j]]]), key=lambda v: v[:2])
    return w, hit, [sorted(f) for f in found], {r: (n, -p, i) for r, (n, p, i) in best.items()}


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of items with about ``block_words`` words, read one after the other."""
    ids, texts, held = [], [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        held += len(text or "") // 5 + 1
        if held >= block_words:
            yield index_block(ids, texts, window)
            ids, texts, held = [], [], 0
    if ids:
        yield index_block(ids, texts, window)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, one_pass) -> DataFrame:
    """docs through a pass for each block; only one block's index is broadcast at a time."""
    send, every = docs.sparkSession.sparkContext.broadcast, blocks(benchmark, window, block_words)
    block = next(every, None) or index_block([], [], window)
    while True:
        held = send(block)
        docs = one_pass(docs, held)
        block = next(every, None)
        if block is None:
            return docs
        docs = frames.stored(docs, "benchmark-pass")
        held.unpersist()


def _merged(texts: pa.Array, block: Block, state: pa.RecordBatch) -> dict[str, object]:
    """STATE's columns of each text after one more block, and the words of each and how many are hit."""
    w, hit, items, best = judge(texts, block)
    bounds = w.bounds()
    hits, n_hit, columns = [], [], {k: state.column(k).to_pylist() for k in STATE.names}
    for r in range(w.rows):
        own = hit[bounds[r] : bounds[r + 1]]
        if columns["hits"][r]:
            own = own | np.unpackbits(np.frombuffer(columns["hits"][r], np.uint8), count=len(own)).astype(bool)
        n_hit.append(int(own.sum()))
        hits.append(np.packbits(own).tobytes() if n_hit[-1] else None)
        if items[r] and columns["items"][r]:
            items[r] = sorted({*items[r], *columns["items"][r]})
        n, p, i = best.get(r, (0, None, None))
        if n > columns["longest"][r] or (n and n == columns["longest"][r] and p < columns["longest_at"][r]):
            columns["longest"][r], columns["longest_at"][r], columns["longest_item"][r] = n, p, i
    return columns | {"items": [a or b or [] for a, b in zip(items, columns["items"], strict=True)], "hits": hits, "n_words": w.per_row(), "n_hit": np.array(n_hit, np.int64)}


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items and the longest verbatim match (words, item, first word) of every row of docs."""
    frames.ready(docs.sparkSession)
    fields = "n_words long, n_hit long, hits binary, items array<string>, longest long, longest_item long, longest_at long"
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), *STATE])
    none = [F.lit(0).cast("long").alias(c) if c in ("n_words", "n_hit", "longest") else F.lit(None).cast(kind).alias(c) for c, kind in (f.split() for f in fields.split(", "))]
    state = frames.ids(docs).select("doc_id", "text", *none)

    def one_pass(rows: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                for part in textcore.slices(batch, "text", SHARD_BYTES):
                    yield frames.batch(schema, doc_id=part.column("doc_id"), text=part.column("text"), **_merged(part.column("text"), block, part))

        return rows.mapInArrow(run, f"doc_id long, text string, {fields}")

    return _passes(state, benchmark, window, block_words, one_pass).select("doc_id", "n_words", "n_hit", "items", "longest", "longest_item", "longest_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a window of a benchmark item; columns as they are."""
    frames.ready(docs.sparkSession)
    names = docs.columns
    at = [n.lower() for n in names].index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def one_pass(rows: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                for part in textcore.slices(batch, f"c{at}", SHARD_BYTES):
                    w, hit, _, _ = judge(part.column(at), block)
                    yield part.filter(pa.array(w.per_row(hit) == 0))

        return rows.mapInArrow(run, plain.schema)

    return _passes(plain, benchmark, window, block_words, one_pass).toDF(*names)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP5_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
dn AS (SELECT doc_id, w, n FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM dn)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract's columns, plainly; for tests."""
    import re

    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    own = []
    for i, t in items:
        seq = cut(t)
        n = min(window, len(seq))
        own.append((i, n, {tuple(seq[k : k + n]) for k in range(len(seq) - n + 1)} if n else set()))
    out = []
    for doc_id, text in docs:
        words, hit, found = cut(text), set(), set()
        at: dict[tuple, list[int]] = {}
        for n in {n for _, n, _ in own if n}:
            for j in range(len(words) - n + 1):
                at.setdefault(tuple(words[j : j + n]), []).append(j)
        for i, n, windows in own:
            for w in windows & at.keys():
                found.add(str(i))
                hit.update(k for j in at[w] for k in range(j, j + n))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
