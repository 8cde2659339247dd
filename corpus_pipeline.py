"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, then SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but
the last return the columns they got, of any names. Defined results: null and empty texts are rejected by the first
stage, and kept as they are by the others, but for line dedup, which drops a text that it leaves without a word; a
document is its (doc_id, text), null ids are ids as any other: repeated rows are one document to line dedup, which treats
them alike, and copies of one another to near-dedup, where one stays; the other stages judge each row alone. Of equal
texts the one of the least id is the first, null ids before all. Very long texts are worked on whole. An empty table
passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_codec
from skein.llm.queries import table, tokenizer
from skein.llm.spool import spool, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a text that loses every word goes."""
    report = unused(docs, "lines")[0]
    out = line_dedup.deduplicate(docs, report=report)
    return out.filter(F.col(report).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(report)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return near_dedup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every benchmark passage cut out."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return sentencepiece_codec.digests(docs, tokenizer())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("sentencepiece", tokens)]

#: SQL cannot express the near-duplicate and SentencePiece stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, name)
    return docs
