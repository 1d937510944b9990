"""Corpus preparation in five stages, each reading what its predecessor kept.

Every stage but the last returns the columns of its input. A stage that
changes ``text`` brings ``n_chars`` up to date.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from floorlens.llm import byte_bpe, crf_language, decontaminate, near_dedup, suffix_dedup
from floorlens.llm.tables import stored

#: A document goes if more than this share of its words is benchmark text.
MOST_COVERED = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null and empty texts and texts without letters
    go. Where nothing tells which languages there are, all documents stay."""
    model = crf_language.fit(docs)
    if model is None:
        return docs
    named = crf_language.predict(docs, model)
    return named.where(F.col("lang_pred") != crf_language.UNKNOWN).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also stand elsewhere."""
    return _counted(suffix_dedup.cut(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; mostly covered documents go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate.clean(docs, items, most_covered=MOST_COVERED))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (packed), and whether they decode to it."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", same.alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: The first stage is a learned model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
