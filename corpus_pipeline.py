"""A corpus pipeline: quality rules, near duplicates, secrets, source mixing, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result
as Parquet in the shared folder and reads it again as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.common import materialise, table
from marketloom.llm.jaccard import near_duplicates
from marketloom.llm.mixing import PARTS, mix_sources
from marketloom.llm.pieces import encode_decode
from marketloom.llm.quality import score_quality
from marketloom.llm.secrets import redacted, secret_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document's place in the mix.
PLACE = ["slot", "in_block"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 6)."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), threshold=None, keep=COLUMNS)
    return scored.filter("kept").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (operator 5).

    Rows of equal id and text are one document, of which the row with the smallest other columns stays; rows that repeat
    an id with another text are documents of their own. Rows without an id are no copies of anything and stay.
    """
    key = ["doc_id", "text_hash"]
    stays = near_duplicates(docs).filter("stays and doc_id is not null").select(key).distinct()
    # one shuffle of the texts serves both the join and the choice among rows of equal id and text
    named = docs.withColumn("text_hash", F.xxhash64("text")).join(stays, key)
    rank = F.row_number().over(W.partitionBy(key).orderBy("lang", "source", "n_chars"))
    once = named.withColumn("_rank", rank).filter("_rank = 1").select(COLUMNS)
    return once.unionByName(docs.filter(F.col("doc_id").isNull()).select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of the secret scan masked (operator 4)."""
    scanned = docs.select("doc_id", "text", "lang", "source", "n_chars", secret_spans(F.col("text")).alias("_spans"))
    masked = scanned.withColumn("_text", redacted(F.col("text"), F.col("_spans")))
    n_chars = F.when(F.size("_spans") > 0, F.length("_text").cast("long")).otherwise(F.col("n_chars"))
    return masked.select("doc_id", F.col("_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def placed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``mixing`` with their places, as ``run`` hands them on."""
    return mix_sources(docs, PARTS).orderBy("slot", "in_block").select(*COLUMNS, *PLACE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixed stream (operator 7): its files, in the order of their names, are the mix."""
    return placed(spark, docs, sf_dir).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte spans of every document (operator 1), with its place in the mix.

    The places are those that ``docs`` has. Where it has none they are worked out again, as files are read in an order of
    their sizes. Sorted by ``slot`` and ``in_block``, the rows are the mix.
    """
    keep = ("doc_id", "lang", "source", *PLACE)
    # written first: places and pieces are then not worked out by two Python workers a task at once
    mixed = docs if set(PLACE) <= set(docs.columns) else materialise(mix_sources(docs, PARTS), "placed")
    found = encode_decode(mixed, public_tokenizers.path("piece_bpe_32k.model"), keep=keep)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", "slot", "in_block")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: What ``run`` calls in a stage's stead: the stage with more columns for the next one.
HANDED = {"mixing": placed}

#: Hashed n-grams, MinHash and sentence pieces have no form in SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES:
        docs = materialise(HANDED.get(name, stage)(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
