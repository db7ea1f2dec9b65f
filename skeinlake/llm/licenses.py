"""License scans by diagonal voting.

Fingerprints of all rolling k-word grams of all documents are joined to the
positions they have in the templates; each match votes for the diagonal document
position minus template position. Neighbouring diagonals (up to a fifth of the
template's words inserted or left out) are merged to spans, and spans with as many
votes as replaced words can leave (``limits``) are verified
against the words themselves: a phrase must stand there word for word, a longer
template to the share ``VERIFIED`` of its words in order. Phrases are templates
like the others, without slack. Templates are a fixed list, so the side that is
broadcast has a fixed size.

Cases: a null text is empty; a text shorter than a gram matches nothing; repeated
rows each get the result; ids may be null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames, textcore

K = 3
VERIFIED = 0.8

#: Phrases whose every place counts, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: License notices, and their labels.
TEMPLATES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _words(texts: pa.Array) -> tuple[textcore.Spans, np.ndarray]:
    w = textcore.alnum_words(texts)
    return w, w.hashes()


def _templates() -> list[tuple[int, str, list[str], bool]]:
    """Number, label, words and whether it is a phrase."""
    out = []
    for label, text, phrase in [(a, b, True) for a, b in PHRASES] + [(a, b, False) for a, b in TEMPLATES]:
        w, _ = _words(pa.array([text]))
        out.append((len(out), label, [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)], phrase))
    return out


def template_grams() -> list[tuple[int, int, int]]:
    """gram, template and position of every gram of the templates."""
    out = []
    for n, _, words, _ in _templates():
        w, h = _words(pa.array([" ".join(words)]))
        grams, at = textcore.windows(h, w.row, K)
        out += [(int(g), n, int(i)) for g, i in zip(grams.view(np.int64), at, strict=True)]
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return frames.ids(docs).withColumn("th", F.xxhash64("text"))


KEY = [("doc_id", pa.int64()), ("th", pa.int64())]


def grams(keyed: DataFrame) -> DataFrame:
    """doc_id, th, pos and gram for every k-word gram."""
    schema = pa.schema([*KEY, ("pos", pa.int64()), ("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text", 1 << 20):
                w, h = _words(part.column("text"))
                found, at = textcore.windows(h, w.row, K)
                row = w.row[at]
                yield frames.batch(schema, doc_id=part.column("doc_id").take(pa.array(row)), th=part.column("th").take(pa.array(row)), pos=at - w.bounds()[row], gram=found.view(np.int64))

    return keyed.mapInArrow(run, "doc_id long, th long, pos long, gram long")


def _holding(keyed: DataFrame) -> DataFrame:
    """The rows whose text has a template's gram: those that the verification may need."""
    known = np.unique(np.array([g for g, _, _ in template_grams()], np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                w, h = _words(part.column("text"))
                found, at = textcore.windows(h, w.row, K)
                place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = np.zeros(part.num_rows, bool)
                hit[w.row[at[known[place] == found]]] = True
                yield part.filter(pa.array(hit))

    return keyed.mapInArrow(run, keyed.schema)


def limits(n_words: int, phrase: bool) -> tuple[int, int]:
    """Words between neighbouring diagonals of one span, and the least votes: a replaced word takes up to K grams, so
    no text is refuted that lost as many words as VERIFIED lets it."""
    grams = max(1, n_words - K + 1)
    if phrase:
        return 0, grams
    lost = n_words * round(10 - 10 * VERIFIED)
    return -(-lost // 10), max(1, grams - K * (lost // 10))


def voted(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """doc_id, th, template, first, last (words) and votes of each span of merged diagonals with enough votes; and
    begin and end, where the whole template would stand by the span's diagonals."""
    info = [(n, len(words), *limits(len(words), phrase)) for n, _, words, phrase in _templates()]
    places = F.broadcast(spark.createDataFrame(template_grams(), "gram long, template int, tpos int"))
    about = F.broadcast(spark.createDataFrame(info, "template int, length int, slack int, least int"))
    hits = grams(keyed).join(places, "gram").select("doc_id", "th", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos").distinct()
    diagonals = hits.groupBy("doc_id", "th", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("tpos").alias("low"), F.max("tpos").alias("high"))
    order = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack"), F.lit(True))
    runs = diagonals.join(about, "template").withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("doc_id", "th", "template", "run").agg(
        F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("first"), (F.max(F.col("diagonal") + F.col("high")) + K).alias("last"),
        F.greatest(F.min("diagonal"), F.lit(0)).alias("begin"), (F.max("diagonal") + F.first("length")).alias("end"), F.first("least").alias("least"),
    )
    return merged.where(F.col("votes") >= F.col("least")).drop("run", "least")


def verified_share(words: list[str], template: list[str], phrase: bool) -> float:
    """Share of the template's words that stand in ``words`` in order; a phrase all or nothing."""
    if phrase:
        return float(words == template)
    blocks = SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


SPAN = "struct<label:string,phrase:boolean,first:bigint,last:bigint,score:double>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and spans (array of label, phrase, first, last, score) of every row of docs."""
    spark = frames.ready(docs.sparkSession)
    keyed = _keyed(docs)
    templates = _templates()
    found = voted(spark, keyed).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("template", "first", "last", "begin", "end"))).alias("found"))
    held = _holding(keyed).distinct().alias("d")
    both = held.join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.th = f.th")).select("d.doc_id", "d.th", "d.text", "f.found")
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([*KEY, ("spans", kind)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                w = textcore.alnum_words(part.column("text"))
                bounds, out = w.bounds(), []
                for r, spans in enumerate(part.column("found").to_pylist()):
                    mine = []
                    for s in spans:
                        _, label, words, phrase = templates[s["template"]]
                        i, j = int(bounds[r]) + s["begin"], min(int(bounds[r]) + s["end"], int(bounds[r + 1]))
                        here = [bytes(w.data[x:y]).decode("utf-8", "replace") for x, y in zip(w.starts[i:j], w.ends[i:j], strict=True)]
                        score = verified_share(here, words, phrase)
                        if score >= (1 if phrase else VERIFIED):
                            mine.append({"label": label, "phrase": phrase, "first": s["first"], "last": s["last"], "score": score})
                    out.append(mine)
                yield frames.batch(schema, doc_id=part.column("doc_id"), th=part.column("th"), spans=pa.array(out, kind))

    spans = both.mapInArrow(verify, f"doc_id long, th long, spans array<{SPAN}>")
    counted = pa.schema([*KEY, ("n_words", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textcore.slices(b, "text"):
                yield frames.batch(counted, doc_id=part.column("doc_id"), th=part.column("th"), n_words=textcore.alnum_words(part.column("text")).per_row())

    every = keyed.mapInArrow(count, "doc_id long, th long, n_words long").alias("d")
    s = spans.alias("s")
    return every.join(s, F.expr("d.doc_id <=> s.doc_id AND d.th = s.th"), "left").select("d.doc_id", "d.n_words", F.coalesce("s.spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["phrase"])
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan(frames.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: F.least(s["score"], F.lit(1.0)))), F.lit(0.0)).alias("score"),
    )
