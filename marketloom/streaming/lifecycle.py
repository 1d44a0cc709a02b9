"""L7. The lifecycle as a stream.

Either every micro-batch is a crawl (``lifecycle_stream``), or postings carry the number of their crawl and come in any
order and in batches of any size (``sightings_stream``): the state then holds what is known of each key's last sightings,
and the lifecycle is worked out when it is read (``lifecycle_view``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.lifecycle import KEY, MISSES, empty_state, lifecycle_merge


def state_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id:012d}"


def lifecycle_batch(root: str, misses: int = MISSES, key: list[str] = KEY):
    """A function for ``foreachBatch``: merges a crawl into the state of the batch before.

    The state after batch ``n`` is a folder of its own, written from that of ``n - 1``, so a repeated batch writes the
    same again. A crawl's time is its latest ``collected_at``; an empty batch is no crawl and leaves the state as it is.
    """

    def run(crawl: DataFrame, batch_id: int) -> None:
        spark = crawl.sparkSession
        before = spark.read.parquet(state_path(root, batch_id - 1)) if batch_id else empty_state(spark)
        newest = crawl.groupBy(*key).agg(F.max_by("content_hash", "collected_at").alias("content_hash"), F.max("collected_at").alias("collected_at"))
        at = crawl.agg(F.max("collected_at")).first()[0]
        if at is None:  # no crawl: nothing is missing for that
            before.write.mode("overwrite").parquet(state_path(root, batch_id))
            return
        lifecycle_merge(newest, before, F.lit(at).cast("timestamp"), misses, key).write.mode("overwrite").parquet(state_path(root, batch_id))

    return run


def lifecycle_stream(crawls: DataFrame, root: str, checkpoint: str, misses: int = MISSES, **trigger):
    """Start the query over a stream of crawls (key, ``content_hash``, ``collected_at``)."""
    writer = crawls.writeStream.foreachBatch(lifecycle_batch(root, misses)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


SIGHTING = "struct<crawl:bigint,seq:bigint,content_hash:string>"


def merged_sightings(facts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``key, first_crawl, seen``: of each key the first crawl that saw it, and the last two, the latest first.

    ``facts`` has the key, ``first_crawl`` and ``seen`` (sightings: crawl, order in it, content). The latest sighting of a
    crawl stands for it. Facts may overlap, repeat and come in any order: the result is the same.
    """
    each = facts.select(*key, "first_crawl", F.explode("seen").alias("s")).groupBy(*key, "s.crawl").agg(F.min("first_crawl").alias("first_crawl"), F.max("s").alias("s"))
    # as many as crawls in a batch, and two
    return each.groupBy(*key).agg(F.min("first_crawl").alias("first_crawl"), F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 2).alias("seen"))


def sightings_batch(root: str, key: list[str] = KEY):
    """A function for ``foreachBatch``: merges postings (key, ``crawl``, ``seq``, ``content_hash``, ``collected_at``) into the state.

    As ``lifecycle_batch``, a batch writes folders of its own from those of the batch before. A repeated batch writes the
    same again, and postings that come a second time in another batch change nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sighting = F.struct(F.col("crawl").cast("long").alias("crawl"), F.col("seq").cast("long").alias("seq"), F.col("content_hash").alias("content_hash"))
        facts = batch.select(*key, F.col("crawl").cast("long").alias("first_crawl"), F.array(sighting).alias("seen"))
        crawls = batch.groupBy(F.col("crawl").cast("long").alias("crawl")).agg(F.max(F.col("collected_at").cast("timestamp")).alias("at"))
        if batch_id:
            before = state_path(root, batch_id - 1)
            facts = facts.unionByName(spark.read.parquet(f"{before}/keys"))
            crawls = crawls.unionByName(spark.read.parquet(f"{before}/crawls")).groupBy("crawl").agg(F.max("at").alias("at"))
        now = state_path(root, batch_id)
        merged_sightings(facts, key).write.mode("overwrite").parquet(f"{now}/keys")
        crawls.write.mode("overwrite").parquet(f"{now}/crawls")

    return run


def sightings_stream(postings: DataFrame, root: str, checkpoint: str, key: list[str] = KEY, **trigger):
    """Start the query over a stream of postings that carry the number of their crawl."""
    writer = postings.writeStream.foreachBatch(sightings_batch(root, key)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def lifecycle_view(spark: SparkSession, root: str, batch_id: int, misses: int = MISSES, key: list[str] = KEY) -> DataFrame:
    """The state after a batch as ``lifecycle_merge`` gives it: every key once, as of the last crawl.

    A crawl counts once any posting of it has come; numbers without a posting are no crawls.
    """
    state = state_path(root, batch_id)
    keys, crawls = spark.read.parquet(f"{state}/keys"), spark.read.parquet(f"{state}/crawls")
    # one row for each crawl: how many came after it, and when the one came that makes a key of it inactive
    calendar = crawls.agg(F.sort_array(F.collect_list(F.struct("crawl", "at"))).alias("c"))
    place = lambda c: F.array_position(F.transform("c", lambda x: x["crawl"]), c)
    known = keys.crossJoin(F.broadcast(calendar)).withColumns({"last": F.col("seen")[0], "before": F.get("seen", F.lit(1))})  # a single row
    runs = F.size("c") - place(F.col("last.crawl"))
    at = lambda i: F.get(F.transform("c", lambda x: x["at"]), i)
    here, missed = runs == 0, runs.cast("int")
    moved = F.coalesce(F.col("before").isNotNull() & (F.col("last.content_hash") != F.col("before.content_hash")), F.lit(False))
    back = F.coalesce(place(F.col("last.crawl")) - place(F.col("before.crawl")) > misses, F.lit(False))
    return known.select(
        *key,
        F.col("last.content_hash").alias("content_hash"),
        at(place(F.col("first_crawl")).cast("int") - 1).alias("first_seen_at"),
        at(place(F.col("last.crawl")).cast("int") - 1).alias("last_seen_at"),
        at(F.size("c") - 1).alias("last_checked_at"),
        F.when(missed >= misses, at(place(F.col("last.crawl")).cast("int") - 1 + misses)).alias("inactive_at"),
        (missed < misses).alias("is_active"),
        missed.alias("consecutive_missing_runs"),
        (here & moved).alias("content_changed"),
        F.when(moved, F.col("before.content_hash")).alias("previous_content_hash"),
        F.when(here & F.col("before").isNull(), "new").when(here, "seen").when(missed >= misses, "inactive").otherwise("missing_unconfirmed").alias("lifecycle_status"),
        (here & back).alias("reactivated"),
    )
