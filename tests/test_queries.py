"""Every registered query against DuckDB on the smallest tables; those without SQL against what tests/test_plain.py works out."""

import pytest

from marketloom.plans.registry import QUERIES, SQL
from tests.oracle import difference
from tests.test_plain import CHECKED


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in SQL:
        assert difference(QUERIES[name](spark, sf), sf, SQL[name]) is None
    else:
        assert name in CHECKED


def test_flagship_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["A1_demand_summary", "D3_group_cross_source", "E7_ability_profile", "L6_lifecycle_replay"])
def test_results_do_not_depend_on_partitions(spark, sf, name):
    from tests.oracle import sparked

    before = sparked(QUERIES[name](spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sparked(QUERIES[name](spark, sf)) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_every_event_enters_the_lifecycle(spark, sf):
    from pyspark.sql import functions as F

    from marketloom.operators.lifecycle import MISSES
    from marketloom.plans.registry import WHOLE_RUNS

    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("s")).collect()
    low, high = min(e.s for e in events), max(e.s for e in events)
    step, seen = (high - low) // WHOLE_RUNS + 1, {}
    for e in sorted(events, key=lambda e: e.event_id):
        seen.setdefault(str(e.user_id), {})[(e.s - low) // step] = e.event_type
    last, wanted = WHOLE_RUNS - 1, {}
    for key, runs in seen.items():
        at = sorted(runs)
        missed = last - at[-1]
        status = ("new" if len(at) == 1 else "seen") if not missed else "inactive" if missed >= MISSES else "missing_unconfirmed"
        back = not missed and len(at) > 1 and at[-1] - at[-2] > MISSES
        wanted[key] = (runs[at[-1]], missed, missed < MISSES, status, back)
    merged = QUERIES["L3_lifecycle_merge_whole"](spark, sf).collect()
    got = {r.source_job_id: (r.content_hash, r.consecutive_missing_runs, r.is_active, r.lifecycle_status, r.reactivated) for r in merged}
    assert got == wanted and len(merged) == len(wanted) and all((r.inactive_at is None) == r.is_active for r in merged)
    counts = {tuple(r) for r in QUERIES["L5_status_counts_whole"](spark, sf).collect()}
    assert counts == {(s, sum(w[3] == s for w in wanted.values())) for s in {w[3] for w in wanted.values()}}
    marked = {r.source_job_id: r.lifecycle_status for r in QUERIES["L4_mark_invalid_whole"](spark, sf).collect()}
    assert marked == {k: "invalid" if int(k) % 3 == 0 else w[3] for k, w in wanted.items()}
