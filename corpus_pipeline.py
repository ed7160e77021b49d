"""The corpus pipeline: five stages over ``documents``, each written and reread.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; all but the last return the columns of documents. Other
columns of docs than doc_id and text are carried along under neutral names, so
none can clash with a column an operator adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, jaccard, pieces, quality, secrets
from tillroll.llm.common import table, written

OWN = ("doc_id", "text")


def _carried(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    names = docs.columns
    under = [c if c in OWN else f"_x{i}" for i, c in enumerate(names)]
    done = work(docs.select(*[F.col(f"`{c}`").alias(u) for c, u in zip(names, under)]))
    return done.select(*[F.col(u).alias(c) for c, u in zip(names, under)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from all of them, does not reject."""
    labels = table(spark, sf_dir, "labels")
    return _carried(docs, lambda d: quality.score(d, quality.train(d, labels)).where("keep"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (word 5-grams, similarity 0.8) the document of the smallest id."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    bench = table(spark, sf_dir, "benchmark")
    return _carried(docs, lambda d: decontaminate.scan(d, bench).where("size(hits) = 0"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return _carried(docs, secrets.redact)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text and its SentencePiece ids; ids of every whole text."""
    e = pieces.encode(docs.select(*OWN))
    return e.select(*OWN, F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece),
]

# Learned models and similarity joins have no SQL form; tests/llm holds the
# rows against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
