"""A corpus pipeline of five stages over documents: quality, lines, near copies, benchmark passages, tokens.

Odd rows. A null text is an empty one: the quality stage rejects it, and the later stages take it for one
without lines, words or tokens. A null host is a host of its own, null ids are ids like others (in the
near-copy stage only those whose whole group has null ids stay). Rows equal in id and text count as one document
and stay or go together; of two texts with one id each is judged by itself. Empty tables, also an empty
benchmark, give empty results or leave documents as they are. Other columns are carried on, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.llm import bpe, decontaminate, line_dedup, quality, simhash
from lexmine.llm.common import checkpoint
from lexmine.llm.queries import WORD_BPE, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above their host's limit; n_chars follows the text."""
    return quality.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of line windows; n_chars follows the text."""
    out = line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its number of tokens and digests of ids and decoded text."""
    return bpe.digests(docs, WORD_BPE)


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark_passages), ("bpe", tokens)]

#: SQL expresses neither fingerprints' components nor alignments nor BPE; tests/llm holds run() against a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written (to the shared checkpoint folder) before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
