"""Lifecycle of postings from one crawl to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["source_id", "source_job_id"]
MISSES = 3


def is_category_page(source, source_name, url) -> Column:
    """F3. A listing page taken for a posting: of the listing source, with ``/danh-muc-`` in its address."""
    hit = (F.lower(source) == F.lit(source_name.lower())) & F.lower(url).contains("/danh-muc-")
    return F.coalesce(hit, F.lit(False))


def prepare_keys(df: DataFrame, required: list[str] = KEY) -> DataFrame:
    """L1. Keys as trimmed strings. Missing columns raise at once, null or blank keys when rows are read."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def checked(c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit(f"null key: {c}"))).otherwise(text)

    return df.withColumns({c: checked(c) for c in required})


def observed_at(current: DataFrame, previous: DataFrame | None = None, given=None) -> DataFrame:
    """L2. One row: the time given, else the latest collection, else the latest sighting, else now."""
    one = current.agg(F.max(F.col("collected_at").cast("timestamp")).alias("c"))
    if previous is not None and "last_seen_at" in previous.columns:
        one = one.join(previous.agg(F.max("last_seen_at").alias("p")))  # one row beside one row
    else:
        one = one.withColumn("p", F.lit(None).cast("timestamp"))
    return one.select(F.coalesce(F.lit(given).cast("timestamp"), "c", "p", F.current_timestamp()).alias("observed_at"))


def lifecycle_merge(current: DataFrame, previous: DataFrame, at: Column, misses: int = MISSES, key: list[str] = KEY) -> DataFrame:
    """L3. The state after a crawl: every key of ``current`` and of ``previous``, once.

    ``current`` has the key, ``content_hash`` and perhaps ``collected_at``; ``previous`` is an earlier result. New and
    seen postings are active; a seen one may be changed or reactivated. A missing one is unconfirmed, and inactive
    after ``misses`` crawls in a row without it. Invalid rows of ``previous`` are kept unless their key is seen again.
    """
    c = current.select(*key, F.col("content_hash").alias("_hash"), *([F.col("collected_at").alias("_at")] if "collected_at" in current.columns else [F.lit(None).cast("timestamp").alias("_at")]), F.lit(True).alias("_here"))
    j = previous.join(c, key, "full_outer")
    here, known = F.col("_here").isNotNull(), F.col("lifecycle_status").isNotNull() & (F.coalesce(F.col("lifecycle_status"), F.lit("")) != "invalid")
    invalid = ~here & (F.col("lifecycle_status") == "invalid")
    runs = F.when(here, 0).otherwise(F.coalesce("consecutive_missing_runs", F.lit(0)) + 1)
    gone = ~here & (runs >= misses)
    old = F.when(known, F.col("content_hash"))
    changed = here & known & (F.coalesce(old, F.lit("")) != "") & (F.coalesce("_hash", F.lit("")) != "") & (old != F.col("_hash"))
    seen = lambda new, otherwise: F.when(here, new).otherwise(otherwise)
    return j.select(
        *key,
        seen(F.col("_hash"), F.col("content_hash")).alias("content_hash"),
        seen(F.coalesce(F.when(known, F.col("first_seen_at")), "_at", at), F.col("first_seen_at")).alias("first_seen_at"),
        seen(at, F.col("last_seen_at")).alias("last_seen_at"),
        F.when(invalid, F.col("last_checked_at")).otherwise(at).alias("last_checked_at"),
        F.when(here, F.lit(None)).when(invalid, F.col("inactive_at")).when(gone, F.coalesce("inactive_at", at)).otherwise(F.col("inactive_at")).cast("timestamp").alias("inactive_at"),
        F.when(invalid, F.col("is_active")).otherwise(~gone).alias("is_active"),
        F.when(invalid, F.col("consecutive_missing_runs")).otherwise(runs).cast("int").alias("consecutive_missing_runs"),
        F.coalesce(changed, F.lit(False)).alias("content_changed"),
        F.when(changed, old).when(here, F.lit(None)).otherwise(F.col("previous_content_hash")).alias("previous_content_hash"),
        F.when(invalid, "invalid").when(here & known, "seen").when(here, "new").when(gone, "inactive").otherwise("missing_unconfirmed").alias("lifecycle_status"),
        F.coalesce(here & known & ~F.coalesce("is_active", F.lit(False)), F.lit(False)).alias("reactivated"),
    )


STATE = (
    "content_hash string, first_seen_at timestamp, last_seen_at timestamp, last_checked_at timestamp, inactive_at timestamp, is_active boolean, "
    "consecutive_missing_runs int, content_changed boolean, previous_content_hash string, lifecycle_status string, reactivated boolean"
)


def empty_state(spark, key_schema: str = "source_id string, source_job_id string") -> DataFrame:
    return spark.createDataFrame([], f"{key_schema}, {STATE}")


def mark_invalid(df: DataFrame, condition: Column, at: Column, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """L4. The valid rows, and state rows of status ``invalid`` for the others."""
    bad = df.filter(F.coalesce(condition, F.lit(False))).select(*key, F.col("content_hash"), at.alias("last_checked_at"), F.lit(False).alias("is_active"), F.lit("invalid").alias("lifecycle_status"))
    return df.filter(~F.coalesce(condition, F.lit(False))), bad


def with_invalid(state: DataFrame, invalid: DataFrame, key: list[str] = KEY) -> DataFrame:
    """L4. State with invalid rows added where the key is not in it; a valid row replaces an invalid one."""
    return state.unionByName(invalid.join(state, key, "left_anti"), allowMissingColumns=True)


def lifecycle_replay(runs: DataFrame, key: str, run_col: str, hash_col: str, misses: int = MISSES) -> DataFrame:
    """L6. The outcome of L3 over a whole series of crawls in one pass.

    ``runs`` has one row for each key seen in a run. The result has one row for each key and each run from its first
    on: status, runs missed so far, whether it was changed or reactivated, without going through the runs one by one.
    """
    numbered = runs.select(run_col).distinct().withColumn("run_no", F.row_number().over(W.orderBy(run_col)))
    seen = runs.join(numbered, run_col).select(F.col(key).alias("key"), "run_no", F.col(hash_col).alias("hash"))
    last_run = numbered.agg(F.max("run_no").alias("last_run"))
    w = W.partitionBy("key").orderBy("run_no")
    stretch = seen.withColumns({"before": F.lag("run_no").over(w), "hash_before": F.lag("hash").over(w), "after": F.lead("run_no").over(w)})
    # one row before one of the last run: a cross join with a single row
    spans = stretch.crossJoin(last_run).withColumn("until", F.coalesce(F.col("after") - 1, "last_run"))
    each = spans.withColumn("at", F.explode(F.sequence("run_no", "until")))
    missed = F.col("at") - F.col("run_no")
    first = missed == 0
    return each.select(
        "key",
        F.col("at").alias("run_no"),
        missed.alias("missing_runs"),
        F.when(first & F.col("before").isNull(), "new").when(first, "seen").when(missed >= misses, "inactive").otherwise("missing_unconfirmed").alias("status"),
        F.coalesce(first & (F.col("hash") != F.col("hash_before")), F.lit(False)).alias("content_changed"),
        F.coalesce(first & (F.col("run_no") - F.col("before") > misses), F.lit(False)).alias("reactivated"),
    )
