"""The training-data pipeline: quality, near duplicates, decontamination, personal data, mixing.

``run`` writes each stage as Parquet to the shared folder and reads it again as the
next stage's documents.  All stages but the last return the columns of ``documents``;
the last drops documents given 0 copies and adds size, source_size, target, copies and taken to the others.

Defined cases, stage by stage: a null text is scored like an empty one, links with nothing, is never cut or changed, has size 0 and so is not in
the mix; very long texts are whole throughout.  Of near duplicates the least doc_id stays, of equal rows of one doc_id one; documents without words are
no duplicates.  A document that loses all its words to decontamination or redaction stays until the mix.  Null sources are a source of their own; null
doc_ids are scored (never learned from) and kept like others.  Empty tables give empty results, labels or benchmark items may be missing.  Further columns
of ``documents``, whatever their names, are kept; ``n_chars`` follows the text; columns named as the last stage's additions make room for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, mixing, pii, quality
from quillon.llm.common import table, written

#: A document goes if the classifier is surer than this that it is junk (score below it).
REJECT_BELOW = 0.5


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage may have changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is not below REJECT_BELOW; labels of the held-out fold are never learned from."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")), REJECT_BELOW)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least doc_id."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that hold benchmark windows."""
    return _resized(decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _resized(pii.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the copies and words it takes of each."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("mixing to target weights", mixing_stage),
]
#: The classifier and the deobfuscation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
