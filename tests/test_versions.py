"""Published versions, the stream of sightings, greedy distinct rows, and reports that differ."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import checks as V
from marketloom.operators import lookups as Q
from marketloom.plans.registry import QUERIES
from marketloom.sources import versions
from marketloom.sources.versions import Conflict, EmptySnapshot, Warehouse
from marketloom.streaming.lifecycle import lifecycle_view, sightings_batch, state_path


def test_one_of_two_publishers_loses_and_starts_again(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    assert house.latest() == 0
    with pytest.raises(ValueError):
        house.table("jobs")
    assert house.publish({"jobs": spark.range(3)}, 0) == 1
    assert house.publish({"jobs": spark.range(5)}, 1) == 2
    with pytest.raises(Conflict):
        house.publish({"jobs": spark.range(9)}, 1)
    assert house.table("jobs").count() == 5 and house.table("jobs", 1).count() == 3
    asked = []

    def make(latest):
        asked.append(latest)
        if len(asked) == 1:  # another one is faster
            Warehouse(spark, str(tmp_path)).publish({"jobs": spark.range(7)}, latest)
        return {"jobs": house.table("jobs", latest).withColumn("v", F.lit(latest))}

    assert house.update(make) == 4 and asked == [2, 3] and house.table("jobs").count() == 7
    with pytest.raises(EmptySnapshot):
        house.publish({"jobs": spark.range(0)}, 4, filled=["jobs"])
    assert house.latest() == 4 and {r.row_count for r in house.manifest(2).collect()} == {5}
    with pytest.raises(ValueError):
        house.table("unknown")
    with pytest.raises(ValueError):
        house.table("jobs", 99)


def test_a_claim_that_two_make_at_once_is_got_by_one(spark, tmp_path, monkeypatch):
    a, b = Warehouse(spark, str(tmp_path)), Warehouse(spark, str(tmp_path))
    a.publish({"jobs": spark.range(1)}, 0)
    claim = a._claim

    def late(number, folder):
        b.publish({"jobs": spark.range(2)}, 1)
        claim(number, folder)

    monkeypatch.setattr(a, "_claim", late)
    with pytest.raises(Conflict):
        a.publish({"jobs": spark.range(3)}, 1)
    assert a.latest() == 2 and a.table("jobs").count() == 2


def test_a_publisher_that_dies_leaves_no_version(spark, tmp_path, monkeypatch):
    house = Warehouse(spark, str(tmp_path))
    house.publish({"jobs": spark.range(1)}, 0)
    (tmp_path / "versions" / f"{2:012d}").write_text("half")
    assert house.latest() == 1 and house.table("jobs").count() == 1
    with pytest.raises(Conflict):  # it may still be at work
        house.publish({"jobs": spark.range(4)}, 1)
    monkeypatch.setattr(versions, "GRACE", 0)
    assert house.publish({"jobs": spark.range(4)}, 1) == 3 and house.table("jobs").count() == 4


def test_a_table_that_stays_the_same_is_not_written_again(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.publish({"jobs": spark.range(6), "skills": lambda written: written["jobs"].selectExpr("id * 2 as skill")}, 0)
    assert house.publish({"jobs": spark.range(4)}, 1, same=["skills"]) == 2
    assert house.update(lambda latest: {"jobs": spark.range(2)}, same=["skills"], filled=["skills"]) == 3
    for n, jobs in ((1, 6), (2, 4), (3, 2)):
        assert house.table("jobs", n).count() == jobs and sorted(r.skill for r in house.table("skills", n).collect()) == [0, 2, 4, 6, 8, 10]
        assert {(r.dataset, r.row_count, r.version) for r in house.manifest(n).collect()} == {("jobs", jobs, n), ("skills", 6, n)}
    assert len(list(tmp_path.glob("data/*/tables/skills"))) == 1 and len(list(tmp_path.glob("data/*/tables/jobs"))) == 3
    with pytest.raises(ValueError):
        house.publish({"jobs": spark.range(1)}, 3, same=["unknown"])
    assert house.publish({"jobs": spark.range(1), "skills": spark.range(0).toDF("skill")}, 3) == 4
    with pytest.raises(EmptySnapshot):
        house.publish({"jobs": spark.range(1)}, 4, same=["skills"], filled=["skills"])
    assert house.latest() == 4 and house.table("skills").count() == 0 and house.table("skills", 3).count() == 6


def test_published_skills_are_written_once(spark, sf, tmp_path, monkeypatch):
    from marketloom.plans import landing
    from marketloom.plans.demo import Roles

    monkeypatch.setattr(landing, "work_dir", lambda spark, name: str(tmp_path / name))
    roles = Roles(spark, sf)
    house = landing._warehouse(roles)
    assert len(list(tmp_path.glob("warehouse/data/*/tables/job_skills"))) == 1
    wanted = sorted(map(tuple, roles["skills"].collect()), key=str)
    assert all(sorted(map(tuple, house.table("job_skills", n).collect()), key=str) == wanted for n in (1, 2, 3))


SIGHTED = "source_id string, source_job_id string, crawl long, seq long, content_hash string, collected_at timestamp"


def sighted(spark, rows):
    return spark.createDataFrame([("s", j, c, n, h, None) for j, c, n, h in rows], SIGHTED).withColumn("collected_at", F.timestamp_seconds(F.col("crawl") * 100))


def test_batches_in_any_order_and_sent_twice_give_the_same_state(spark, tmp_path):
    rows = [("a", 0, 1, "x"), ("a", 0, 2, "y"), ("a", 5, 3, "z"), ("b", 0, 4, "x"), ("b", 1, 5, "x"), ("c", 3, 6, "q"), ("c", 4, 7, "q"), ("d", 5, 8, "n"), ("e", 0, 9, "o"), ("e", 2, 9, "p")]
    wanted = None
    for k in range(3):
        order = list(rows)
        random.Random(k).shuffle(order)
        root, run = str(tmp_path / str(k)), sightings_batch(str(tmp_path / str(k)))
        for batch, at in enumerate(range(0, len(order), 3)):
            run(sighted(spark, order[at : at + 3]), batch)
            run(sighted(spark, order[at : at + 3]), batch)  # sent again
        run(sighted(spark, order[:4]), batch + 1)  # and once more, as another batch
        got = {r.source_job_id: r for r in lifecycle_view(spark, root, batch + 1).collect()}
        assert wanted is None or got == wanted
        wanted = got
    seen = {j: (r.lifecycle_status, r.consecutive_missing_runs, r.is_active, r.content_hash, r.previous_content_hash, r.reactivated, r.content_changed) for j, r in wanted.items()}
    assert seen == {
        "a": ("seen", 0, True, "z", "y", True, True),
        "b": ("inactive", 4, False, "x", None, False, False),
        "c": ("missing_unconfirmed", 1, True, "q", None, False, False),
        "d": ("new", 0, True, "n", None, False, False),
        "e": ("inactive", 3, False, "p", "o", False, False),
    }
    seconds = lambda t: None if t is None else int(t.timestamp())
    assert seconds(wanted["b"].inactive_at) - seconds(wanted["b"].last_seen_at) == 300 and wanted["c"].inactive_at is None
    assert state_path("r", 3).endswith("batch=000000000003")


def kept_by_hand(rows):
    ids, prompts, out = set(), set(), []
    for place, i, p in sorted(set(rows), key=lambda r: (r[0], str(r[1]), str(r[2]))):
        if (i is None or i not in ids) and (p is None or p not in prompts):
            out.append((place, i, p))
            ids.add(i)
            prompts.add(p)
    return out


def test_rows_go_only_for_rows_that_were_kept(spark):
    rng = random.Random(8)
    for n in (0, 1, 40):
        rows = [(k, rng.choice(["a", "b", "c", "d", "e", "f"]), rng.choice(["p", "q", "r", "s", "t"])) for k in range(n)]
        rows += [(3, None, "q"), (4, "z", None), (4, "z", None)] if n else []
        df = spark.createDataFrame(rows, "place int, id string, prompt string")
        got = sorted((tuple(r) for r in Q.keep_first(df, ["id", "prompt"], ["place"]).select("place", "id", "prompt").collect()), key=str)
        assert got == sorted(kept_by_hand(rows), key=str)
    chain = spark.createDataFrame([(0, "a", "p"), (1, "a", "q"), (2, "b", "q"), (3, "b", "r")], "place int, id string, prompt string")
    assert {r.place for r in Q.keep_first(chain, ["id", "prompt"], ["place"]).collect()} == {0, 2}


def test_distinct_questions_of_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    ids, prompts, want = set(), set(), set()
    for turn, conv, prompt in sorted({(r.turn, r.conv_id, " ".join((r.text or "").split()).lower()) for r in turns}):
        if conv not in ids and prompt not in prompts:
            want.add((conv, turn))
            ids.add(conv)
            prompts.add(prompt)
    assert {(r.conv_id, r.turn) for r in QUERIES["Q13_distinct_questions"](spark, sf).collect()} == want


def test_reports_that_differ(spark):
    left = spark.sql("select 3 as n, 0.5 as rate, 'v1' as version, map('a', 1, 'b', 2) as per, cast(null as string) as note")
    right = spark.sql("select 4L as m, 0.50000000001D as rate, 'v1' as version, map('a', 1L, 'c', 2L) as per, cast(null as string) as note")
    fields = {"n": "m", "rate": "rate", "version": "version", "per": "per", "note": "note"}
    got = {(r.rule, r.key, r.detail) for r in V.report_differences(left, right, fields).collect()}
    assert got == {("differs:n", "", "3/4"), ("differs:per", "b", "2/null"), ("differs:per", "c", "null/2")}
    assert {r.rule for r in V.report_differences(left, right.limit(0), fields).collect()} == {"differs:n", "differs:rate", "differs:version", "differs:per"}


def test_hidden_questions_hide_others(spark):
    answers = spark.createDataFrame([("s", "q0", "no"), ("s", "q1", "yes"), ("s", "q2", "yes"), ("t", "q0", "yes"), ("t", "q1", "yes"), ("t", "q2", "no")], "submission_id string, question_id string, value string")
    conditions = spark.createDataFrame([("q1", "q0", "equals", "yes"), ("q2", "q1", "equals", "yes"), ("q3", "q2", "equals", "yes")], "question_id string, depends_on string, operator string, operand string")
    got = {(r.submission_id, r.question_id) for r in V.visible_chained(conditions, answers).filter("is_visible").collect()}
    assert got == {("t", "q1"), ("t", "q2")}
    circle = spark.createDataFrame([("a", "b", "equals", "1"), ("b", "a", "equals", "1")], "question_id string, depends_on string, operator string, operand string")
    both = spark.createDataFrame([("s", "a", "1"), ("s", "b", "1"), ("t", "a", "1")], "submission_id string, question_id string, value string")
    assert {(r.submission_id, r.question_id) for r in V.visible_chained(circle, both).filter("is_visible").collect()} == {("s", "a"), ("s", "b")}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_are_worked_out_once_for_all_fields(spark):
    from pyspark.sql import functions as F

    left, right = (spark.range(n).agg(F.sum("id").alias("a"), F.max("id").alias("b"), F.min("id").alias("c")) for n in (10, 9))
    found = V.report_differences(left, right, {"a": "a", "b": "b", "c": "c"})
    assert plan_of(found).count("Range (") == 2
    assert {tuple(r) for r in found.collect()} == {("differs:a", "", "45/36"), ("differs:b", "", "9/8")}
