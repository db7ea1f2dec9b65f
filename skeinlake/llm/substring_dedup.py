"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored greedily against reference blocks that together index
the whole corpus. A block holds stretches of text: runs of neighbouring windows of
``WINDOW`` words whose least ``SEED``-word gram falls to it. No other block can match
such a window, so a stretch is parsed against the one block that can. The block's
index is a suffix array over the windows of its stretches. From a place whose window
also starts in a smaller document, binary search finds the longest match with text of
such a document; it becomes a factor (place, length, source, place there), and parsing
goes on at the first window that isn't whole inside the factor. So all windows across a
factor's end are looked up too, and no window is missed: what the factors cover is
what the contract removes, wherever they end. Factors of neighbouring stretches that
continue each other in the same source become one.

What crosses the network is packed: per stretch the seed and the document, and for
each window 40 further bits of a second fingerprint; equality is decided on 104 bits.
Before that each task takes its own texts as a first reference block, and sends only
the windows without a smaller document there, so a passage that a third of all
documents hold is sent once a task and not once a document.

Documents are ordered by id; a null id is larger than all. Cases: a null text has
no words; texts under ``WINDOW`` words lose nothing; texts of any length are parsed
whole; rows that share an id never remove from each other; repeated rows get the same
result; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, textcore

WINDOW, SEED = 13, 3
#: Text that a task looks through by itself before it sends, and text for each reference block.
OWN_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20
LAST = (1 << 63) - 1

#: Steps in which all stretches are parsed together; then, if fewer than FEW are left, each by itself, so many places at once.
ROUNDS, FEW, CHASED = 64, 256, 1 << 18

#: A factor: its first window, windows, source document and first window there.
RUN = np.dtype([("start", "<i4"), ("n", "<i4"), ("source", "<i8"), ("place", "<i4")])
DOC_RUN = np.dtype([("ord", "<i8"), ("th", "<i4"), ("run", RUN)])


def _planes(a: np.ndarray) -> bytes:
    """An integer array by byte planes, which compress well where the numbers are small."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplaned(data: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def seeds_and_windows(w: textcore.Spans, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its seed, 40 bits of the other fingerprint, and the word where it starts."""
    n = len(w.starts) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = np.zeros(len(w.starts), np.int8)
    grams, _ = textcore.windows(w.hashes(0), one, seed, 0)
    least = _sliding_min(grams, window - seed + 1)
    whole, _ = textcore.windows(w.hashes(1), one, window, 1)
    at = np.flatnonzero(w.row[:n] == w.row[window - 1 :])
    return least[at], whole[at] >> np.uint64(24), at


class Index:
    """Suffix array of stretches of windows. token: equal for equal windows; order: of the window's document;
    new: whether a stretch begins. Only windows that stand in several documents are indexed."""

    def __init__(self, token: np.ndarray, order: np.ndarray, new: np.ndarray):
        by = np.argsort(token, kind="stable")
        edge = np.ones(len(by), bool)
        edge[1:] = token[by][1:] != token[by][:-1]
        begin, group = np.flatnonzero(edge), np.cumsum(edge) - 1
        low, high = (f.reduceat(order[by], begin) if len(by) else order for f in (np.minimum, np.maximum))
        self.later, indexed = np.zeros(len(by), bool), np.zeros(len(by), bool)
        self.later[by] = order[by] != low[group]
        indexed[by] = (low != high)[group]
        ids = np.zeros(len(by), np.int64)
        ids[by] = group + 1
        at = self.at = np.flatnonzero(indexed)
        size = self.size = len(at)
        if not size:
            return
        first = new[at].copy()
        first[0] = True
        first[1:] |= at[1:] != at[:-1] + 1
        self.stretches = np.flatnonzero(first)
        ends = np.append(self.stretches[1:], size)
        self.end = np.repeat(ends, ends - self.stretches)
        self.room = self.end - np.arange(size)
        self.order = order[at]
        due = np.where(self.later[at], np.arange(size), size)
        self.next_later = np.append(np.minimum.accumulate(due[::-1])[::-1], size)
        self._sort(ids[at])

    def _sort(self, ids: np.ndarray) -> None:
        """Ranks of all suffixes by their first 1, 2, 4 ... windows, until no match between documents is longer."""
        rank = self._dense(ids)[1]
        self.ranks, step = [rank], 1
        while True:
            ahead = np.zeros(self.size, np.int64)
            on = np.flatnonzero(self.room > step)
            ahead[on] = rank[on + step]
            by, rank = self._dense(rank.astype(np.int64) * (self.size + 1) + ahead)
            begin = np.flatnonzero(np.append(True, rank[by][1:] != rank[by][:-1]))
            docs = self.order[by]
            full = self.room[by[begin]] >= 2 * step
            step *= 2
            if not (full & (np.minimum.reduceat(docs, begin) != np.maximum.reduceat(docs, begin))).any():
                break
            self.ranks.append(rank)
        self.suffixes = by.astype(np.int32)
        # places by document and place, so that the least of a range of suffixes is the first place of the smallest document
        self.places = np.argsort(self.order, kind="stable").astype(np.int32)
        own = np.empty(self.size, np.int32)
        own[self.places] = np.arange(self.size, dtype=np.int32)
        self.least, width = [own[by]], 1
        while 2 * width <= self.size:
            before = self.least[-1]
            self.least.append(np.minimum(before[:-width], before[width:]))
            width *= 2

    @staticmethod
    def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of keys, and their ranks from 1."""
        by = np.argsort(key, kind="stable")
        rank = np.empty(len(by), np.int32)
        rank[by] = np.cumsum(np.append(True, key[by][1:] != key[by][:-1]))
        return by, rank

    def _edge(self, k: int, done: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        """The first suffix in [low, high) whose rank by 2**k windows from ``done`` on is want or more (after: more)."""
        low, high = low.copy(), high.copy()
        while True:
            on = np.flatnonzero(low < high)
            if not len(on):
                return low
            middle = (low[on] + high[on]) // 2
            suffix = self.suffixes[middle]
            has = self.room[suffix] > done[on]
            found = np.where(has, self.ranks[k][np.minimum(suffix + done[on], self.size - 1)], 0)
            right = found <= want[on] if after else found < want[on]
            low[on[right]] = middle[right] + 1
            high[on[~right]] = middle[~right]

    def longest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, windows of the longest match with a smaller document, and the place of the match."""
        done, low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), self.size)
        source = np.zeros(len(at), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            on = np.flatnonzero(self.room[at] >= done + (1 << k))
            if not len(on):
                continue
            want, d = self.ranks[k][at[on] + done[on]], done[on]
            a = self._edge(k, d, want, low[on], high[on], False)
            b = self._edge(k, d, want, a, high[on], True)
            some = np.flatnonzero(a < b)
            on, a, b = on[some], a[some], b[some]
            p = np.frexp((b - a).astype(np.float64))[1] - 1  # 2**p suffixes fit
            first = np.empty(len(on), np.int64)
            for q in np.unique(p).tolist():
                x = np.flatnonzero(p == q)
                first[x] = np.minimum(self.least[q][a[x]], self.least[q][b[x] - (1 << q)])
            place = self.places[first]
            fits = self.order[place] < self.order[at[on]]
            on = on[fits]
            done[on] += 1 << k
            low[on], high[on], source[on] = a[fits], b[fits], place[fits]
        return done, source

    def parse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Factors of all stretches: window, windows, and window of the source, by window."""
        if not self.size:
            return (np.zeros(0, np.int64),) * 3
        at, out, rounds = self.stretches, [], 0
        end = self.end[at]
        while True:
            at = self.next_later[at]
            on = at < end
            at, end = at[on], end[on]
            if not len(at):
                break
            if rounds >= ROUNDS and len(at) < FEW:
                out += self._chased(at, end)
                break
            n, source = self.longest(at)
            out.append((at, n, source))
            at, rounds = at + n, rounds + 1
        where, n, source = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        by = np.argsort(where, kind="stable")
        return self.at[where[by]], n[by], self.at[source[by]]

    def _chased(self, at: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Factors of a few long stretches: all of their places are looked up at once, then each is followed."""
        out = []
        for a, e in zip(at.tolist(), end.tolist(), strict=True):
            for low in range(a, e, CHASED):
                places = np.arange(low, min(low + CHASED, e))
                places = places[self.next_later[places] == places]
                n, source = self.longest(places)
                size, known = dict(zip(places.tolist(), n.tolist(), strict=True)), []
                while a < min(low + CHASED, e):
                    known.append(a)
                    a = int(self.next_later[a + size[a]])
                known = np.array(known, np.int64)
                x = np.searchsorted(places, known)
                out.append((known, n[x], source[x]))
        return out


def tokens(seed: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return textcore.mix(seed + rest * np.uint64(0x9E3779B97F4A7C15))


def _runs(index: Index, order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The factors as RUNs, and the window where each begins."""
    at, n, source = index.parse()
    out = np.zeros(len(at), RUN)
    out["start"], out["n"], out["source"], out["place"] = start[at], n, order[source], start[source]
    return out, at


def _binary(runs: np.ndarray, groups: np.ndarray) -> pa.Array:
    """Neighbouring runs of one group as one binary value each; groups: where each begins."""
    offsets = (np.append(groups, len(runs)) * RUN.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(groups), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(runs.tobytes())])


SENT = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("ord", pa.int64()), ("th", pa.int32())])
ANSWER = pa.schema([("ord", pa.int64()), ("th", pa.int32()), ("runs", pa.binary())])


class _Own:
    """Windows of the texts that a task has seen since it last sent."""

    def __init__(self, blocks: int, window: int, seed: int):
        self.blocks, self.window, self.seed = blocks, window, seed
        self.clear()

    def clear(self) -> None:
        self.parts, self.order, self.th, self.bytes = [], [], [], 0

    def add(self, part: pa.RecordBatch) -> None:
        w = textcore.words(part.column("text"))
        seed, rest, at = seeds_and_windows(w, self.window, self.seed)
        row = w.row[at]
        docs = sum(map(len, self.order))
        self.parts.append((seed, rest, (row + docs).astype(np.int64), (at - w.bounds()[row]).astype(np.int32)))
        self.order.append(part.column("ord").to_numpy())
        self.th.append(part.column("th").to_numpy().astype(np.int32))
        self.bytes += len(w.data)

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        seed, rest, doc, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order, th = np.concatenate(self.order), np.concatenate(self.th)
        self.clear()
        own, fresh = order[doc], np.append(True, doc[1:] != doc[:-1])
        index = Index(tokens(seed, rest), own, fresh)
        runs, at = _runs(index, own, start)
        if len(runs):
            of = doc[at]
            groups = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            of = of[groups]
            yield pa.RecordBatch.from_arrays([pa.array(of % self.blocks), pa.array(np.zeros(len(of), np.int64)), _binary(runs, groups), pa.array(order[of]), pa.array(th[of])], schema=SENT)
        at = np.flatnonzero(~index.later)
        del index
        if not len(at):
            return
        seed, rest, doc, start = seed[at], rest[at], doc[at], start[at]
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (seed[1:] != seed[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        bucket = (seed[first] % np.uint64(self.blocks)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        first, size, bucket = first[by], size[by], bucket[by]
        tail = rest.view(np.uint8).reshape(-1, 8)[:, :5]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
            f, m = first[a:b], size[a:b]
            w = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - f, m)
            own = order[doc[f]]
            data = b"".join((seed[f].tobytes(), _planes(np.diff(own, prepend=np.int64(0))), th[doc[f]].tobytes(), _planes(start[f]), _planes(m.astype(np.int32)), tail[w].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])]), pa.array([b - a], pa.int64()), pa.array([data], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int32())], schema=SENT)


def _unpacked(n: int, data: memoryview) -> tuple[np.ndarray, ...]:
    """seed, rest, order, th, start of each window, and whether it begins a stretch."""
    seed = np.frombuffer(data, np.uint64, n)
    order = np.cumsum(_unplaned(data[8 * n :], "<i8", n))
    th = np.frombuffer(data, np.int32, n, 16 * n)
    start = _unplaned(data[20 * n :], "<i4", n)
    m = _unplaned(data[24 * n :], "<i4", n).astype(np.int64)
    rest = np.zeros((int(m.sum()), 8), np.uint8)
    rest[:, :5] = np.frombuffer(data, np.uint8, len(rest) * 5, 28 * n).reshape(-1, 5)
    run = np.repeat(np.arange(n), m)
    step = np.arange(len(run)) - np.repeat(np.cumsum(m) - m, m)
    return seed[run], rest.view(np.uint64).ravel(), order[run], th[run], start[run] + step.astype(np.int32), step == 0


def _packed(order: np.ndarray, th: np.ndarray, runs: np.ndarray, groups: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """A reference block's answers by the part of the documents that they are for. groups: where each document's begin."""
    if not len(groups):
        return
    size = np.diff(np.append(groups, len(runs)))
    part = _part(order, parts)
    by = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.append(True, part[by][1:] != part[by][:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(by)), strict=True):
        d = by[a:b]
        n = size[d]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - groups[d], n)
        out = np.zeros(len(at), DOC_RUN)
        out["ord"], out["th"], out["run"] = np.repeat(order[d], n), np.repeat(th[d], n), runs[at]
        yield int(part[d[0]]), out.tobytes()


def _part(order: np.ndarray, parts: int) -> np.ndarray:
    return (textcore.mix(order.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def answers(table: pa.Table, parts: int) -> pa.Table:
    """A reference block's answers to all windows that were sent to it, and the answers that tasks gave themselves:
    a packed value for each part of the documents."""
    table = table.combine_chunks()
    out: dict[int, list[bytes]] = {}
    local = table.filter(pa.compute.equal(table["n"], 0))
    if local.num_rows:
        sizes = np.array([len(d.as_buffer()) for d in local["data"]]) // RUN.itemsize
        runs = np.frombuffer(b"".join(local["data"].to_pylist()), RUN)
        for k, blob in _packed(local["ord"].to_numpy(), local["th"].to_numpy(), runs, np.cumsum(sizes) - sizes, parts):
            out.setdefault(k, []).append(blob)
    sent = table.filter(pa.compute.greater(table["n"], 0))
    if sent.num_rows:
        unpacked = [_unpacked(n.as_py(), memoryview(d.as_buffer())) for n, d in zip(sent["n"], sent["data"], strict=True)]
        seed, rest, order, th, start, new = (np.concatenate(x) for x in zip(*unpacked, strict=True))
        runs, at = _runs(Index(tokens(seed, rest), order, new), order, start)
        if len(runs):
            edge = np.ones(len(at), bool)
            edge[1:] = (order[at[1:]] != order[at[:-1]]) | (th[at[1:]] != th[at[:-1]])
            groups = np.flatnonzero(edge)
            for k, blob in _packed(order[at[groups]], th[at[groups]], runs, groups, parts):
                out.setdefault(k, []).append(blob)
    return pa.table({"part": pa.array(list(out), pa.int64()), "data": pa.array([b"".join(v) for v in out.values()], pa.binary())})


def merged(table: pa.Table) -> pa.Table:
    """All answers for a part of the documents: a row for each document."""
    runs = np.unique(np.frombuffer(b"".join(table["data"].to_pylist()), DOC_RUN))
    first = np.flatnonzero(np.append(True, (runs["ord"][1:] != runs["ord"][:-1]) | (runs["th"][1:] != runs["th"][:-1]))) if len(runs) else np.zeros(0, np.int64)
    return pa.Table.from_arrays([pa.array(runs["ord"][first]), pa.array(runs["th"][first]), _binary(np.ascontiguousarray(runs["run"]), first)], schema=ANSWER)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("ord", F.coalesce("doc_id", F.lit(LAST))).withColumn("th", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def found(docs: DataFrame, window: int = WINDOW, seed: int = SEED, own_bytes: int = OWN_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ord, th and runs (packed RUNs) of each document that has windows with a smaller source."""
    spark = frames.ready(docs.sparkSession)
    keyed = _keyed(docs).where("text IS NOT NULL")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(frames.partitions(spark), -(-total // block_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Own(blocks, window, seed)
        for b in batches:
            for part in textcore.slices(b, "text"):
                own.add(part)
                if own.bytes >= own_bytes:
                    yield from own.send()
        yield from own.send()

    sent = keyed.mapInArrow(send, "bucket long, n long, data binary, ord long, th int")
    # as many parts of the answers as blocks: both keep their size, and their number grows with the text
    given = sent.groupBy("bucket").applyInArrow(lambda t: answers(t, blocks), "part long, data binary")
    return given.groupBy("part").applyInArrow(merged, "ord long, th int, runs binary")


def factors(packed: bytes) -> np.ndarray:
    """RUNs of one document in order; those that continue each other in one source, across stretches, are one factor."""
    runs = np.unique(np.frombuffer(packed, RUN))
    if not len(runs):
        return runs
    new = np.ones(len(runs), bool)
    before = runs[:-1]
    new[1:] = (runs["start"][1:] != before["start"] + before["n"]) | (runs["source"][1:] != before["source"]) | (runs["place"][1:] != before["place"] + before["n"])
    at = np.flatnonzero(new)
    out = runs[at].copy()
    out["n"] = np.add.reduceat(runs["n"], at)
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("factors", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])))])


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts: bool = True, **how) -> DataFrame:
    """RESULT's columns of every row: kept words joined by one space, and the factors with their source document
    (null: the source has no id). texts: without it kept is null."""
    frames.ready(docs.sparkSession)
    plain = frames.ids(docs)
    joined = _keyed(plain).join(found(plain, window, seed, **how), ["ord", "th"], "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                w = textcore.words(part.column("text"))
                bounds = w.bounds()
                gone, lists = np.zeros(len(w.starts), bool), []
                for r, packed in enumerate(part.column("runs").to_pylist()):
                    f = factors(packed) if packed else ()
                    own = np.zeros(bounds[r + 1] - bounds[r] + 1, np.int64) if len(f) else None
                    if own is not None:
                        np.add.at(own, f["start"], 1)
                        np.add.at(own, f["start"] + f["n"] + window - 1, -1)
                        gone[bounds[r] : bounds[r + 1]] = np.cumsum(own[:-1]) > 0
                    lists.append([{"start": int(x["start"]), "words": int(x["n"]) + window - 1, "source": None if x["source"] == LAST else int(x["source"]), "source_start": int(x["place"])} for x in f])
                data, offs = textcore.joined(w, ~gone)
                pieces = [data[a : max(a, z - 1)].tobytes() for a, z in zip(offs[:-1], offs[1:], strict=True)]
                yield frames.batch(
                    RESULT, doc_id=part.column("doc_id"), n_words=w.per_row(), n_removed=w.per_row(gone),
                    kept=pa.array([p.decode() for p in pieces] if texts else [None] * len(pieces), pa.string()),
                    kept_sha256=[hashlib.sha256(p).hexdigest() for p in pieces], factors=pa.array(lists, RESULT.field("factors").type),
                )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, factors array<struct<start:long,words:long,source:long,source_start:long>>")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    d = deduplicated(frames.table(spark, sf_dir, "documents"), texts=False)
    return d.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM x GROUP BY s),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x JOIN f ON x.s = f.s WHERE m < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN h ON p.doc_id = h.doc_id AND p.i = h.i GROUP BY p.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
