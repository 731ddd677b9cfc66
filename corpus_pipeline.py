"""The corpus pipeline: documents pass five stages, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir). The first four return the columns of ``documents``
without the rows that they reject; the last returns token counts and digests of the rest.

* toxicity: rows that score the threshold or more go
* exact dedup: of equal texts the row with the largest doc_id stays
* n-gram Jaccard join: texts link at 0.8 of their 5-word shingles; of each component of near copies the row with the least doc_id stays
* benchmark decontamination: rows that overlap with a benchmark item go
* byte-level BPE: token ids of the rest, as count and digests, with what decoding gives back
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiform.llm import decontaminate, exact_dedup, ngram_join, prefix_bpe, toxicity
from lexiform.llm.common import discard, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs, percent=80, words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: A fitted classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id with token counts and digests, without the texts. A stage's table is deleted when the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return docs
