"""A training corpus from documents: rules, line dedup, near-dedup, decontamination, mixing.

STAGES are functions (spark, docs, sf_dir) -> DataFrame; each works on all that
the one before kept, and all but the last return the columns of documents.
run() writes each stage's result as Parquet to the shared folder and reads it
back for the next, so a lost executor costs a stage at most.

Every stage reads whole texts; an empty table gives no rows in each (rules then
need labels of documents outside of it and keep nothing to judge); other columns
pass through whatever their names, but for the last stage, which has its own. Rows
are judged row by row: repeated rows get one verdict, and only near-dedup makes one
of them. Line dedup and near-dedup order documents by id, a null id last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinlake.llm import decontamination, frames, line_dedup, mixing, near_dedup, quality

#: The trees and the sampling aren't expressible in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the trees score below the threshold go.

    Null and empty texts and those of under ten words fail the base rule; very long texts are scored like others; ties
    at the threshold stay; equal rows stay or go together; a null id without a label is judged like any other."""
    return quality.accepted(docs, quality.train(docs, frames.table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in blocks shared with an earlier document go, and with them documents of which fewer words are left than
    the rules ask for: they were copies.

    Null and empty texts and those without a shared block stay as they are, short ones too; rows of one id and text
    are one document and all stay; of equal texts with unlike ids the first keeps its lines."""
    return line_dedup.cleaned(docs, least_words=quality.MIN_WORDS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one document stays.

    Null and empty texts are linked with nothing and stay; a text under five words is one shingle; of repeated rows one
    stays; the smallest id stays, and of rows without an id one of each text."""
    return near_dedup.kept(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Null and empty texts hold none and stay; an item under ten words must occur whole; equal rows stay or go together."""
    return decontamination.decontaminate(docs, frames.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of the documents that the mix takes.

    Null and empty texts have size 0 and are never taken; a null source is a source; rows of one key are ordered by id,
    and repeated rows are taken or left one by one."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    with frames.scratch(spark):
        for name, stage in STAGES:
            docs = frames.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), outer=stage is STAGES[-1][1])
    return docs
