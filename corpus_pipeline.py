"""The corpus pipeline: documents through five operators, each stage on what its predecessor kept.

The quality rules reject documents, near-duplicates leave one document of each group, secrets are replaced by a mark,
sources are mixed to their target weights by repeating or leaving out documents, and what remains is encoded.  All
stages but the last return the columns of documents.

Defined cases, in every stage: a null or empty text fails the quality rules, has the zero fingerprint, no secrets, and no
tokens; a null id is a document of its own that is never dropped as a duplicate, and is mixed as the id 'null'; rows with
one id are one document in near duplicates (the row of least hash stays) and have equal counts in the mix; a null source is
a source of its own; further columns, whatever their names, are carried through all but the last stage; an empty table
gives no rows; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import bpe, mixing, quality, secrets, simhash
from lodeweave.llm.queries import MIX
from lodeweave.llm.shared import checkpointed, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.  The trees learn from the labelled ones among docs."""
    trees = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_kept(trees, F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark, and n_chars follows."""
    out = docs.withColumn("text", secrets.redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight and chance say, in a global order by chance."""
    return mixing.poisson_mix(docs, MIX).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and both digests of every row."""
    return bpe.bpe_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("source mix", source_mix),
    ("byte bpe", byte_bpe),
]

#: Trees trained on labels can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpointed(docs) if k else docs, sf_dir)
    return docs
