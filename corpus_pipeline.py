"""Corpus cleaning over ``documents``: quality, exact copies, near copies, benchmark passages, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of ``documents``. ``run`` writes each stage's rows to the shared folder before the next reads them.

In every stage a null text counts as empty, ids may be null or repeat, further columns are kept whatever their names, and an empty
table gives an empty one. Of rows that repeat id and text the exact stage keeps one; other stages treat such rows alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cofolio.llm import bpe, decontaminate, exact_dedup, near_dedup, quality, queries
from cofolio.llm.scratch import cut


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, fitted on the labels, doesn't reject; without labels of both kinds it rejects all or none."""
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; rows of null id stay, as do texts without a word unless equal."""
    return near_dedup.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; an empty text has none."""
    return decontaminate.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text; 0 and the digests of nothing for an empty text."""
    return bpe.encode_digests(docs, queries.word_bpe_path())


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_exact_copies),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", token_ids),
]

#: A trained classifier and weighted sampling aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = _read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{k}")
    return docs
