"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import jaccard, langid, mixing, packing, pii
from onomast.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL: profiles, dependent rounding and packing aren't expressible; tests compare with plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or hardly alike to any learned language, go."""
    return langid.keep_identified(docs.select(COLUMNS), COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group that shares 80 % of its 5-word shingles stays."""
    return jaccard.keep_one(docs.select(COLUMNS), words=5, percent=80)


def sanitise_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced in the texts."""
    return pii.sanitise(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their target weights."""
    return mixing.repeated(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near duplicates", join_near_duplicates),
    ("personal data", sanitise_text),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
