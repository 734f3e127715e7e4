"""From raw documents to packed sequences, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the
last return the columns of `documents`; ids may repeat after mixing, which takes some documents
more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltraffic.llm.common import crc_mod, settled, table
from sqltraffic.llm.exact_dedup import exact_dedup
from sqltraffic.llm.language_id import UNDETERMINED, identify, learn
from sqltraffic.llm.mixing import mix_documents
from sqltraffic.llm.ngram_join import near_dedup
from sqltraffic.llm.packing import pack
from sqltraffic.llm.queries import SEQUENCE, vocabulary


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told, with that as their `lang`; those without any letter go. Null and empty texts have none."""
    judged = identify(docs, learn(docs, crc_mod(F.col("doc_id"), 3) != 1))
    told = judged.where(F.col("lang_pred") != UNDETERMINED)
    return told.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for blanks, the longest, then the one of the smallest id; one of rows that are equal in both."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar five-word shingles, the one of the smallest id. Rows that share an id are judged together; those of a null id or
    without words stay."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in the schedule's order, which packing keeps. A null source is one of its own, and those without
    words are not taken."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their places in sequences, numbered in the mix's order. Null texts are empty; texts longer than a sequence are cut."""
    return pack(docs, vocabulary(), SEQUENCE)


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Packing and language ID cannot be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
