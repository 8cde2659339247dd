"""The registered queries of the corpus operators, and SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bloom_lm, decontamination, line_dedup, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """The place of a public tokenizer's file; SKEIN_TOKENIZERS overrides the folder."""
    if at := os.environ.get("SKEIN_TOKENIZERS"):
        return f"{at}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_decontamination, op3_warc, op4_line_dedup, op5_quality_rules, op6_url_filter, op7_quality_classifier, op8_suffix_dedup, op9_near_dedup, op10_bloom_lm)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontamination.SQL, "op3_warc": warc.SQL, "op4_line_dedup": line_dedup.SQL, "op5_quality_rules": quality_rules.SQL, "op8_suffix_dedup": suffix_dedup.SQL}
