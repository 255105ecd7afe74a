"""The corpus pipeline: language ID, toxicity, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. SQL can't express them, so the tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, language, neardup, packing, toxicity
from tallyframe.llm.shared import stored, table


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no language's centroid accepts, and texts that are null or without a letter. Repeated rows stay or go
    together; without any labelled text everything goes."""
    model = language.fit_language(docs.where(_crc_mod(3) != 1))
    return docs.where(~language.detect_language(model, docs["text"])["rejected"])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts with a toxicity score of 0.5 or more. Null and empty texts have the score of a text without a known
    word and so stay where toxic texts are the fewer; without any labelled text nothing goes."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(_crc_mod(5) != 0))
    return docs.where(toxicity.score_toxicity(model, docs["text"]) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: the one of the least doc_id (see deduplicate for ties, null
    ids and repeated rows). Null texts all stay, of equal texts without words one."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, repeated rows together; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of the permitted lengths; null and empty texts are pieces of length 0."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
