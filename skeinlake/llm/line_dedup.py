"""Line dedup by pairwise alignment.

The candidate keys of a document are its shortest blocks of neighbouring lines
that reach ``block_words`` words, from each line on and up to each line: single
long lines and runs of short ones, repeated in the document or not. What a longer
block holds is covered by them. Every key leads to the first document that has it,
and the two documents become a pair. Each pair is aligned by patience diff over
two fingerprints of each line, and aligned common blocks of at least ``block_words`` words
are deleted from the later document. Shared blocks that no alignment deleted
go on to their next earlier holders, in rounds that each try ``STEP`` times as
many, until every such block is deleted or has no holder left: the result is that
of aligning all pairs, and no line is too frequent to count. Documents of equal
lines are one holder. All alignments are made on the documents as they came in.

Documents are ordered by id, a null id last, then by text fingerprint. Cases: a
null text has no lines and stays null; lines without a word never pair documents
and are deleted only inside a block; rows repeated in full are one document, and
each is returned; texts are read whole; an empty table gives no rows; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, textcore

BLOCK_WORDS = 5
LAST = (1 << 63) - 1
#: Each round tries so many times the holders of the one before.
STEP = 8
#: Parts in which the holders of a block are ranked before they are ranked together.
RANK_PARTS = 32


def _lines(texts: pa.Array) -> tuple[textcore.Spans, np.ndarray, np.ndarray]:
    """The lines that aren't empty, their fingerprints and words."""
    lines = textcore.spans(texts, textcore.LINE)
    w = textcore.words(texts)
    n = np.bincount(np.searchsorted(lines.starts, w.starts, "right") - 1, minlength=len(lines.starts)) if len(w.starts) else np.zeros(len(lines.starts), np.int64)
    return lines, lines.hashes().view(np.int64), n


def _increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned indexes of a and b, increasing in both: what is unique in both ranges anchors them; equal lines
    next to an anchor or an end are aligned with it; the ranges between anchors are aligned in turn."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {h: i for i, h in enumerate(a[a0:a1], a0) if na[h] == 1 and nb.get(h) == 1}
        common = [(place[h], j) for j, h in enumerate(b[b0:b1], b0) if h in place]
        anchors = [common[k] for k in _increasing([i for i, _ in common])]
        for i, j in anchors:
            out.append((i, j))
            todo.append((a0, i, b0, j))
            a0, b0 = i + 1, j + 1
        if anchors:
            todo.append((a0, a1, b0, b1))
    return sorted(out)


def deleted(a: list[int], b: list[int], words: list[int], block_words: int) -> list[int]:
    """Lines of b in aligned blocks of at least ``block_words`` words."""
    out, run, held, last = [], [], 0, (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if held >= block_words:
                out += run
            run, held = [], 0
        run.append(j)
        held += words[j] if j >= 0 else 0
        last = i, j
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return frames.ids(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("th"), "text").where("text IS NOT NULL")


def _found(lines: textcore.Spans, h: np.ndarray, n: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest blocks of lines with ``block_words`` words from each line on and up to each line: fingerprints,
    first lines and lengths in lines. They cover every line of every longer block."""
    size = len(h)
    bounds = lines.bounds()
    words = np.concatenate(([0], np.cumsum(n)))
    every = np.arange(size)
    to = np.searchsorted(words, words[:-1] + block_words)
    ahead = to <= bounds[lines.row + 1]
    since = np.searchsorted(words, words[1:] - block_words, "right") - 1
    behind = since >= bounds[lines.row]
    at, end = np.concatenate((every[ahead], since[behind])), np.concatenate((to[ahead], every[behind] + 1))
    at, end = np.divmod(np.unique(at * (size + 1) + end), size + 1)
    base = 0x9E3779B97F4A7C15
    up, down = np.full((2, size + 1), [[base], [pow(base, -1, 1 << 64)]], np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(h.view(np.uint64) * up[:-1], out=total[1:])
    return textcore.mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64)).view(np.int64), at, end - at


def _whole(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint of each row's sequence of lines."""
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(textcore.mix(h.view(np.uint64) + textcore.mix(place.astype(np.uint64) + np.uint64(1))), out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def twofold(seqs: pa.Array, seqs2: pa.Array) -> list[list[tuple[int, int]]]:
    """Each line as both of its fingerprints: lines that differ in one never align."""
    return [list(zip(x, y, strict=True)) for x, y in zip(seqs.to_pylist(), seqs2.to_pylist(), strict=True)]


def _open(blocks: list[dict[str, int]], gone: list[int]) -> list[dict[str, int]]:
    """Those blocks of which a line isn't gone; gone is in order."""
    at, size = (np.array([b[c] for b in blocks], np.int64) for c in ("at", "size"))
    return [blocks[k] for k in np.flatnonzero(np.searchsorted(gone, at + size) - np.searchsorted(gone, at) < size)]


def removals(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """ord, th and lines: the numbers, among lines that aren't empty, of each document's lines to delete."""
    with frames.scratch(docs.sparkSession):
        return frames.stored(_removals(_keyed(docs), block_words), "line-removals", outer=True)


def _removals(keyed: DataFrame, block_words: int) -> DataFrame:
    parts = frames.partitions(keyed.sparkSession)
    flat = pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
    whole = pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("seq", pa.list_(pa.int64())), ("seq2", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                lines, h, n = _lines(part.column("text"))
                bounds = lines.bounds()
                key, at, size = _found(lines, h, n, block_words)
                row = lines.row[at]
                s1, s2 = _whole(h, bounds), _whole(lines.hashes(1).view(np.int64), bounds)
                take = pa.array(row)
                yield frames.batch(flat, ord=part.column("ord").take(take), th=part.column("th").take(take), s1=s1[row], s2=s2[row], key=key, at=at - bounds[row], size=size)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                lines, h, n = _lines(part.column("text"))
                at = pa.array(lines.bounds().astype(np.int32))
                yield frames.batch(whole, ord=part.column("ord"), th=part.column("th"), seq=pa.ListArray.from_arrays(at, pa.array(h)), seq2=pa.ListArray.from_arrays(at, pa.array(lines.hashes(1).view(np.int64))), words=pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32))))

    me = F.struct("ord", "th")
    blocks = frames.stored(keyed.mapInArrow(keys, "ord long, th long, s1 long, s2 long, key long, at int, size int"), "line-keys")
    # stored, so that the joins get two plain shuffles, of which Spark splits what a very common block would put into one task
    first = frames.stored(blocks.groupBy("key").agg(F.min(me).alias("a"), F.max(me).alias("other")).where("a < other").select("key", "a"), "line-first")
    held = frames.stored(blocks.join(first, "key").select("ord", "th", "s1", "s2", "key", "at", "size", "a"), "line-shared")
    involved = held.select("ord", "th").distinct()
    seqs = frames.stored(keyed.mapInArrow(sequences, "ord long, th long, seq array<long>, seq2 array<long>, words array<int>").dropDuplicates(["ord", "th"]).join(involved, ["ord", "th"], "left_semi"), "line-sequences")
    a = seqs.select(F.col("ord").alias("a_ord"), F.col("th").alias("a_th"), F.col("seq").alias("a_seq"), F.col("seq2").alias("a_seq2"))
    result = pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("lines", pa.list_(pa.int32()))])
    block = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
    waiting = pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("gone", pa.list_(pa.int32())), ("blocks", pa.list_(block))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (twofold(b.column(c), b.column(f"{c}2")) for c in ("a_seq", "seq"))
            found = [deleted(*z, block_words) for z in zip(x, y, b.column("words").to_pylist(), strict=True)]
            out = frames.batch(result, ord=b.column("ord"), th=b.column("th"), lines=pa.array(found, result.field("lines").type))
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [sorted({*x.as_py(), *(y.as_py() or ())}) for x, y in zip(b.column("gone"), b.column("lines"), strict=True)]
            still = [_open(x.as_py(), g) for x, g in zip(b.column("blocks"), gone, strict=True)]
            out = frames.batch(waiting, ord=b.column("ord"), th=b.column("th"), gone=pa.array(gone, waiting.field("gone").type), blocks=pa.array(still, waiting.field("blocks").type))
            yield out.filter(pa.array([bool(x) for x in still], pa.bool_()))

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(seqs, ["ord", "th"]).join(a, ["a_ord", "a_th"]).select("ord", "th", "seq", "seq2", "words", "a_seq", "a_seq2")
        gone = both.mapInArrow(align, "ord long, th long, lines array<int>")
        return frames.stored(gone.groupBy("ord", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines")), "line-gone")

    later = held.where(F.col("a") < me)
    pair = [F.col("a.ord").alias("a_ord"), F.col("a.th").alias("a_th"), "ord", "th"]
    gone = found = aligned(later.select(*pair).distinct())
    wait = later.groupBy("ord", "th").agg(F.collect_set(F.struct("key", "at", "size")).alias("blocks")).withColumn("gone", F.array().cast("array<int>"))
    tried, more = 1, STEP
    while True:
        wait = wait.join(found, ["ord", "th"], "left").mapInArrow(left, "ord long, th long, gone array<int>, blocks array<struct<key:bigint,at:int,size:int>>")
        wait = frames.stored(wait, "line-waiting")
        ask = wait.select("ord", "th", F.explode(F.array_distinct(F.col("blocks.key"))).alias("key"))
        asked = frames.stored(ask.select("key").distinct(), "line-asked")
        if asked.isEmpty():
            break
        # the holders of a very common block are dealt out anew before they are summed, and ranked in parts first
        open_ = held.join(asked, "key", "left_semi").select("key", "s1", "s2", me.alias("a")).repartition(parts, "key", "s1", "s2")
        holders = open_.groupBy("key", "s1", "s2").agg(F.min("a").alias("a"))
        share = F.pmod(F.xxhash64("s1"), F.lit(RANK_PARTS))
        near = holders.withColumn("part", share).withColumn("rank", F.row_number().over(Window.partitionBy("key", "part").orderBy("a"))).where(F.col("rank") <= tried + more)
        near = near.select("key", "a").repartition(parts, "key")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("a"))).where(F.col("rank") <= tried + more).where(F.col("rank") > tried)
        pairs = frames.stored(ask.join(ranked, "key").where(F.col("a") < me).select(*pair).distinct(), "line-pairs")
        if pairs.isEmpty():
            break
        found = aligned(pairs)
        gone = gone.unionByName(found)
        tried, more = tried + more, more * STEP
    return gone.groupBy("ord", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def without_lines(text: str, gone: list[int]) -> str:
    """text without those of its lines that aren't empty and have these numbers."""
    out, n, drop = [], 0, set(gone)
    for line in text.split("\n"):
        if line:
            n += 1
            if n - 1 in drop:
                continue
        out.append(line)
    return "\n".join(out)


def cleaned(docs: DataFrame, block_words: int = BLOCK_WORDS, more: bool = False, least_words: int = 0) -> DataFrame:
    """docs with the deleted lines gone from text. more: also n_lines and n_removed as the last two columns.
    least_words: rows that lost lines and hold fewer words than that afterwards go."""
    frames.ready(docs.sparkSession)
    names = docs.columns
    low = [n.lower() for n in names]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = f"c{low.index('doc_id')}", f"c{low.index('text')}"
    keyed = plain.withColumn("ord", F.coalesce(F.col(i).cast("long"), F.lit(LAST))).withColumn("th", F.xxhash64(F.col(t).cast("string")))
    joined = keyed.join(removals(docs, block_words), ["ord", "th"], "left").select(*plain.columns, "lines", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    out = joined.drop("lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, t):
                gone = part.column("lines").to_pylist()
                texts = part.column(t)
                if any(gone):
                    texts = pa.array([without_lines(x.as_py(), g) if g else x.as_py() for x, g in zip(texts, gone, strict=True)], texts.type)
                lines = textcore.spans(part.column(t), textcore.LINE).per_row()
                columns = {f.name: part.column(f.name) for f in part.schema if f.name != "lines"} | {t: texts, "n_lines": pa.array(lines), "n_removed": pa.array([len(g or ()) for g in gone], pa.int64())}
                out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                if least_words and any(gone):
                    out = out.filter(pa.array((textcore.words(texts).per_row() >= least_words) | ~np.array([bool(g) for g in gone])))
                yield out

    result = joined.mapInArrow(run, out.schema).toDF(*names, "n_lines", "n_removed")
    return result if more else result.toDF(*[f"c{k}" for k in range(len(names) + 2)]).select(*plain.columns).toDF(*names)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = frames.ids(frames.table(spark, sf_dir, "documents"))
    return cleaned(docs, more=True).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
