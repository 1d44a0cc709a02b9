"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import chats
from marketloom.llm.alignment import align_tokenizers
from marketloom.llm.byte_pairs import encode_bytes
from marketloom.llm.common import shared_dir, table
from marketloom.llm.jaccard import near_duplicates
from marketloom.llm.licenses import scan_licenses
from marketloom.llm.mixing import PARTS, mix_sources
from marketloom.llm.neighbours import nearest
from marketloom.llm.pieces import encode_decode
from marketloom.llm.quality import score_quality
from marketloom.llm.secrets import joined_spans, scan_secrets
from marketloom.llm.substrings import remove_repeats
from marketloom.llm.tokens import Ledger, count_tokens
from marketloom.llm.whitening import whiten


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("bytes_covered"),
        F.xxhash64("starts", "ends").alias("spans_hash"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        F.size("starts").cast("long").alias("n_intervals"),
    )


def op3_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] != "entropy")
    return found.select(
        "doc_id",
        *(count(kind) for kind in ("assign", "access", "hex", "entropy")),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("found")).alias("spans"),
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=None)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), PARTS)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in; those labelled toxic go; those labelled bad are counted
    again with each line once. The second batch is sent twice."""
    tokenizers = {
        "words-1": None,
        "byte_bpe_50k-1": (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    }
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = Ledger(spark, shared_dir(spark, "token-ledger"))
    event = lambda df, op: df.select("doc_id", F.lit(op).alias("op"), "source", "lang", "tokenizer", "n_tokens")
    ledger.commit("load", event(count_tokens(docs, tokenizers), "insert"))
    toxic = labels.filter("toxic = 1").select("doc_id")
    for _ in range(2):
        ledger.commit("takedown", event(ledger.state().join(toxic, "doc_id", "left_semi"), "delete"))
    # texts that repeat a line are found and counted where they are read; only counts meet the labels
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    recounted = count_tokens(docs.withColumn("_once", once).filter("_once <> text").withColumn("text", F.col("_once")), tokenizers)
    bad = labels.filter("quality = 0").select("doc_id").join(toxic, "doc_id", "left_anti").distinct()
    ledger.commit("lines-once", event(recounted.join(bad, "doc_id", "left_semi"), "revise"))
    return ledger.totals()


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["notice"].isNull())
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first_word"])
    scores = F.transform(
        "matches", lambda m: F.when(m["notice"].isNull(), F.lit(1.0)).otherwise(1 - m["edits"] / F.length(m["notice"]))
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = encode_bytes(table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return align_tokenizers(table(spark, sf_dir, "documents"), *files)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_vantage_point_trees": op3_vantage_point_trees,
    "op4_secret_scans": op4_secret_scans,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_token_counts": op9_token_counts,
    "op10_license_scans": op10_license_scans,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL: dict[str, str] = {"op8_chat_formatting": chats.SQL}
