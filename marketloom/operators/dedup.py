"""Duplicates of postings, and boilerplate that a source repeats from posting to posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import block_key


def with_duplicate_count(df: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """D1. ``duplicate_count``: rows with the same hash. A join on counts, so that no hash gathers its rows."""
    counts = df.groupBy(F.col(hash_col).alias("_h")).agg(F.count("*").alias("duplicate_count"))
    return df.join(counts, df[hash_col].eqNullSafe(counts["_h"]), "left").drop("_h")


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """D2, D5. The last row of each key by ``order``, nulls never if there is another, which must end in a unique column.

    A task passes on one row of each key only, so that a hot key's rows do not meet.
    """
    return _first(df, keys, [F.col(c).desc_nulls_last() for c in order])


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """D4. The first row of each key by ``order``, nulls last, which must end in a unique column."""
    return _first(df, keys, [F.col(c).asc_nulls_last() for c in order])


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_dedup_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_dedup_rank = 1").drop("_dedup_rank")


def dedup_identity(df: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    """D2. One row for each posting of a source, the one taken in last."""
    keyed = df.withColumns(
        {"_source": F.coalesce("source_id", "source"), "_job": F.coalesce(F.nullif(F.col("source_job_id"), F.lit("")), F.col("job_id"))}
    )
    return dedup_last(keyed, ["_source", "_job"], [seq_col]).drop("_source", "_job")


def group_cross_source(df: DataFrame, key_col: str = "cross_source_key", source_col: str = "source_id") -> DataFrame:
    """D3. ``cross_group_id`` and ``cross_group_size`` for rows whose key is found in two sources or more."""
    groups = (
        df.filter(F.col(key_col).isNotNull())
        .groupBy(F.col(key_col).alias("_key"))
        .agg(F.count("*").alias("cross_group_size"), F.min(source_col).alias("_a"), F.max(source_col).alias("_b"))
        .filter("_a <> _b")
        .select("_key", F.concat(F.lit("xsrc_"), F.substring(F.sha2(F.col("_key").cast("binary"), 256), 1, 16)).alias("cross_group_id"), "cross_group_size")
    )
    return df.join(groups, df[key_col] == groups["_key"], "left").drop("_key")


def text_blocks(df: DataFrame, id_col: str, group_col: str, text_col: str) -> DataFrame:
    """Lines of a text as blocks: id, group, ``pos``, ``block``, ``key``; blank lines go."""
    lines = df.select(id_col, group_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "block"))
    return lines.withColumn("key", block_key("block")).filter("key <> ''")


def boilerplate_keys(blocks: DataFrame, id_col: str, group_col: str, share: float = 0.8, least_docs: int = 3) -> DataFrame:
    """B1. Keys in at least ``ceil(share * documents)`` of a group's documents, for groups of ``least_docs`` or more."""
    once = blocks.select(id_col, group_col, "key").distinct()
    docs = once.select(id_col, group_col).distinct().groupBy(group_col).agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_docs)
    counts = once.groupBy(group_col, "key").agg(F.count("*").alias("n"))
    return counts.join(docs, group_col).filter(F.col("n") >= F.ceil(F.col("docs") * share)).select(group_col, "key", "n", "docs")


def split_boilerplate(df: DataFrame, keys: DataFrame, id_col: str, group_col: str, text_col: str) -> DataFrame:
    """B2. For each document its own text and the boilerplate, in order, with counts and the share of blocks.

    A key is in a large share of its group's documents, so a join on it would be the hottest there is. Instead the few
    keys of a group are gathered in one row, and a document's lines are looked up there without leaving it. Documents
    without a block are left out.
    """
    known = keys.groupBy(F.col(group_col).alias("_g")).agg(F.collect_set("key").alias("_keys"))  # at most 1 / share times a document's lines
    lines = F.transform(F.split(text_col, "\n"), lambda x: F.struct(x.alias("block"), block_key(x).alias("key")))
    cut = df.select(id_col, group_col, F.filter(lines, lambda x: x["key"] != "").alias("_b")).filter(F.size("_b") > 0)
    joined = cut.join(known, F.col(group_col).eqNullSafe(F.col("_g")), "left").withColumn("_keys", F.coalesce("_keys", F.array().cast("array<string>")))
    marked = joined.select(id_col, group_col, F.transform("_b", lambda x: F.struct(x["block"].alias("block"), F.array_contains("_keys", x["key"]).alias("common"))).alias("_b"))
    text = lambda common: F.array_join(F.transform(F.filter("_b", lambda x: x["common"] == common), lambda x: x["block"]), "\n")
    n = F.size(F.filter("_b", lambda x: x["common"]))
    return marked.select(
        id_col,
        group_col,
        text(F.lit(False)).alias("role_text"),
        text(F.lit(True)).alias("boilerplate_text"),
        F.size("_b").cast("long").alias("block_count"),
        n.cast("long").alias("boilerplate_count"),
        F.round(n / F.size("_b"), 4).alias("boilerplate_ratio"),
    )


def boilerplate_stats(split: DataFrame, group_col: str) -> DataFrame:
    """B3. Per group: documents, mean share of boilerplate, lengths before and after, and quartiles of the latter."""
    after = F.length("role_text")
    before = after + F.length("boilerplate_text")
    return split.groupBy(group_col).agg(
        F.count("*").alias("docs"),
        F.round(F.avg("boilerplate_ratio"), 4).alias("mean_ratio"),
        F.max("boilerplate_ratio").alias("max_ratio"),
        F.sum(before).alias("chars_before"),
        F.sum(after).alias("chars_after"),
        F.percentile_approx(after, [0.25, 0.5, 0.75], 10_000).alias("length_quartiles"),
    )
