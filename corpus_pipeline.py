"""The corpus pipeline: documents through quality rules, near copies, repeated paragraphs, test leaks and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamlens.llm import decontaminate, host_rules, jaccard_join, paragraph_dedup
from streamlens.llm.common import stored, table
from streamlens.llm.queries import packed
from streamlens.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the rules or their host's verdict reject go."""
    ship_package(spark)
    return host_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies the document of smallest id stays."""
    ship_package(spark)
    return jaccard_join.keep_one(docs, jaccard_join.ngram_components(docs))


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: a paragraph that repeats stays in one document and is cut out of the others."""
    ship_package(spark)
    found = paragraph_dedup.repeats(docs, shortest=paragraph_dedup.SHINGLE)
    return paragraph_dedup.without_repeats(docs, paragraph_dedup.whole_spans(docs, found))


def test_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: what is left, as pieces of sequences."""
    ship_package(spark)
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_paragraphs),
    ("benchmark decontamination", test_leaks),
    ("packing", packing),
]

#: SQL has no tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
