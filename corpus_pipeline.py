"""The corpus pipeline: documents that are worth training on, packed into token sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolens.llm.decontamination import decontaminated
from cargolens.llm.minhash import without_near_duplicates
from cargolens.llm.packing import pack, token_pieces
from cargolens.llm.quality import of_quality
from cargolens.llm.secrets import redacted
from cargolens.llm.storage import saved


#: Similarity of near duplicates in hundredths; op8 by itself has its own.
NEAR = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return of_quality(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at 0.8 of their shingles, stays."""
    return without_near_duplicates(docs, least=NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a placeholder; no document goes."""
    return redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and places."""
    return pack(token_pieces(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; the last one's rows."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
