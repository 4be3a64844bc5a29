"""From raw documents to training sequences: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from secflow.llm import near_copies, packing, quality_model, secret_scan, toxicity
from secflow.llm.common import documents, labels
from secflow.queries.registry import Section
from secflow.settings import work_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The rows come from fitted models and packing in random groups, so SQL cannot express them.
ORACLE_SQL = None


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go."""
    return quality_model.good_ones(docs, labels(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return near_copies.deduplicate(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values that look like live credentials are replaced; documents stay."""
    return secret_scan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_50k.tiktoken"),
                        vocabularies.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [("toxicity", clean_language), ("quality", good_quality),
                                   ("near_duplicates", one_of_each), ("secrets", no_secrets), ("packing", sequences)]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written in the shared folder and read again.

    A stage's table is removed once the next one is written; packing has stored what it needs when it returns.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(path), path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _remove(spark, before)
    return packed


section = Section()
section.add("pipeline", run, ORACLE_SQL)
