"""Rules on literal rows, with the values that the rules' description gives."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import aggregate as A
from marketloom.operators import checks as V
from marketloom.operators import dedup as D
from marketloom.operators import learner as E
from marketloom.operators import pages as P
from marketloom.operators import profiles as C
from marketloom.operators.postings import user_segment


def test_unanswered_questions_are_wrong(spark):
    tests = spark.createDataFrame([("u", "c"), ("v", "none")], "user_id string, career_id string")
    questions = spark.createDataFrame([("c", 1, "One?", "Yes"), ("c", 2, "Two?", "no"), ("c", 3, "Free?", None), ("none", 4, "Free?", None)], "career_id string, question_id int, prompt string, expected string")
    answers = spark.createDataFrame([("u", 1, " YES\t"), ("u", 3, "text")], "user_id string, question_id int, answer string")
    got = {r.user_id: (r.score, r.wrong, r.skill_gaps) for r in A.grade_tests(tests, questions, answers, ["career_id"], ["user_id"]).collect()}
    assert got == {"u": (50.0, 1, {2: "Two?"}), "v": (0.0, 0, {})}


def test_unanswered_questions_meet_no_condition(spark):
    answers = spark.createDataFrame([("s", "q1", ""), ("t", "q1", "no"), ("u", "q2", "x")], "submission_id string, question_id string, value string")
    conditions = spark.createDataFrame([("q9", "q1", "not_equals", "yes")], "question_id string, depends_on string, operator string, operand string")
    assert {r.submission_id: r.is_visible for r in V.visible(conditions, answers).collect()} == {"s": False, "t": True, "u": False}


def test_segments(spark):
    people = [
        ("STUDENT", "HIGH_SCHOOL", "C1", None, "C1", "HS_FOUNDATION"), ("STUDENT", "UNIVERSITY", "C1", None, "C1", "SV_SAME_MAJOR"), ("STUDENT", None, None, None, "C1", "SV_DIFF_MAJOR"),
        ("STUDENT", "UNIVERSITY", "C2", "C1", "C1", "SV_DIFF_MAJOR"), ("PROFESSIONAL", None, None, "C1", "C1", "WORKER_SAME_FIELD"), ("PROFESSIONAL", "HIGH_SCHOOL", "C1", "C2", "C1", "WORKER_DIFF_FIELD"),
        ("TEACHER", None, None, None, "C1", "HS_FOUNDATION"), (None, None, None, None, None, "HS_FOUNDATION"),
    ]
    df = spark.createDataFrame(people, "role string, stage string, major string, career string, target string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", user_segment("role", "stage", "major", "career", "target")).collect())


ACADEMIC = "student_id string, gap_id string, skill_id string, gap_size double, priority string"
OPEN = "student_id string, career_group_id string, pos int, activity_id string, priority string"


def test_plans_and_next_steps_skip_what_is_done(spark):
    students = spark.createDataFrame([("a", 60, False), ("b", 60, False), ("c", 60, True), ("d", 10, False)], "student_id string, weekly_available_minutes int, exam_week boolean")
    gaps = [(s, f"GAP_{k}", f"S{k}", size, "high") for s in "abcd" for k, size in ((1, 0.1), (2, 0.5), (3, 0.9))]
    academic = spark.createDataFrame(gaps, ACADEMIC)
    limits = spark.createDataFrame([("S1", "A1", 20), ("S2", "A2", 45), ("S3", None, None)], "skill_id string, activity_id string, activity_minutes int")
    interests = spark.createDataFrame([(s, g, k, a, "high") for s in "abcd" for k, (g, a) in enumerate((("G9", None), ("G0", "X0"), ("G1", "X1")))], OPEN)
    catalog = spark.createDataFrame([("X0", 15), ("X1", 40)], "activity_id string, estimated_minutes int")
    done = spark.createDataFrame([("b", "A2"), ("b", "X0")], "student_id string, activity_id string")
    plan = sorted(tuple(r) for r in E.weekly_plan(students, academic, interests, limits, catalog, done).collect())
    # the larger gap first; b has done it and the first interest; the second interest is not tried when the first does not fit
    assert plan == [("a", 1, "A2", 45), ("a", 2, "X0", 15), ("b", 1, "A1", 20), ("b", 2, "X1", 40), ("c", 1, "A2", 45)]
    steps = {r.student_id: (r.step, r.activity_id) for r in E.next_step(students, academic, interests, limits, done).collect()}
    assert steps == {"a": ("academic", "A2"), "b": ("academic", "A1"), "c": ("academic", "A2"), "d": ("academic", "A2")}
    every = spark.createDataFrame([("a", "A1"), ("a", "A2")], "student_id string, activity_id string")
    assert E.next_step(students, academic, interests, limits, every).filter("student_id = 'a'").first().activity_id == "X0"
    none = E.next_step(students, academic.limit(0), interests.limit(0), limits, every).filter("student_id = 'a'").first()
    assert (none.step, none.activity_id) == ("none", None)


def test_outcome_labels(spark):
    values = [(-0.05, "regression"), (-0.04, "no_meaningful_change"), (0.0, "no_meaningful_change"), (0.05, "partial_improvement"), (0.2, "meaningful_improvement")]
    got = spark.createDataFrame(values, "d double, want string").withColumn("got", E.outcome_status(F.col("d"))).collect()
    assert all(r.want == r.got for r in got)
    key = "student_id string, skill_id string"
    before = spark.createDataFrame([("s", "A", 0.5, "improving"), ("s", "B", 0.1, "declining")], f"{key}, estimated_level double, trend string")
    outcomes = spark.createDataFrame([("s", "A", "no_meaningful_change")], f"{key}, status string")
    got = {r.skill_id: (r.estimated_level, r.trend) for r in E.overlay_profile(before, before.filter("skill_id = 'A'"), outcomes).collect()}
    assert got == {"A": (0.5, "stable"), "B": (0.1, "declining")}


def test_warnings(spark):
    schema = "student_id string, evidence_id string, source_type string, skill_id string, normalized_value double, confidence double, observed_at timestamp"
    evidence = spark.createDataFrame([("a", "1", "self_report", "SKILL_X", 0.4, 1.0, None), ("b", "2", "assessment", "SKILL_X", 0.0, 1.0, None), ("b", "3", "academic_record", "SKILL_X", 1.0, 1.0, None)], schema)
    found = {tuple(r) for r in E.evidence_warnings(evidence).collect()}
    assert found == {("a", "insufficient_evidence", "ability_profile.SKILL_X"), ("a", "low_confidence_estimate", "ability_profile.SKILL_X"), ("b", "conflicting_evidence", "ability_profile.SKILL_X"), ("b", "low_confidence_estimate", "ability_profile.SKILL_X")}
    students = spark.createDataFrame([("a", ["G0", "G7"]), ("b", [])], "student_id string, career_interest_ids array<string>")
    market = spark.createDataFrame([("G0", 4)], "career_group_id string, sample_size int")
    catalog = spark.createDataFrame([("G0", "X", 5)], "career_group_id string, activity_id string, estimated_minutes int")
    first = {tuple(r) for r in E.initial_warnings(students, {"self_report": evidence.filter("student_id = 'a'")}, evidence, catalog, market).collect()}
    assert first - found == {
        ("b", "optional_data_missing", "self_report"), ("a", "insufficient_evidence", "ability_profile"), ("a", "unknown_career_group", "student.career_interest_ids.1"),
        ("a", "small_market_sample", "market_context"), ("b", "small_market_sample", "market_context"),
    } and found <= first
    posts = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], "student_id string, attempt_id long, idx int")
    paired = spark.createDataFrame([(2, 10), (3, 11)], "posttest_id long, baseline_id long")
    skills = spark.createDataFrame([(2, "S"), (10, "T"), (3, "S"), (11, "S")], "attempt_id long, skill_id string")
    versions = spark.createDataFrame([("a", "1", "2"), ("b", "", "2")], "student_id string, current_version string, expected_version string")
    assert {tuple(r) for r in E.followup_warnings(posts, paired, skills, versions).collect()} == {
        ("a", "baseline_not_found", "assessment_attempts.posttest.0"), ("a", "assessment_scale_mismatch", "assessment_attempts.posttest.1.skill_scores"), ("a", "stale_profile_version", "student.schema_version"),
    }


def test_conflicting_evidence_is_an_error(spark):
    items = spark.createDataFrame([("1", "a", 0.1), ("1", "a", 0.1), ("2", "a", 0.2)], "evidence_id string, skill_id string, v double")
    assert E.merge_evidence(items, items).count() == 2
    odd = items.unionByName(spark.createDataFrame([("2", "a", 0.3)], items.schema))
    with pytest.raises(Exception, match="conflicting evidence"):
        E.merge_evidence(odd).collect()
    assert E.merge_evidence(odd, strict=False).count() == 3


def test_gaps_market_and_profiles(spark):
    jobs = spark.createDataFrame([("1", None, None, "HN", "ONSITE"), ("2", "C", 0.95, None, "REMOTE"), ("3", "C", 0.5, None, None), ("4", "C", None, None, "UNSPECIFIED")], "job_id string, career_id string, career_confidence double, province string, work_mode string")
    tags = spark.createDataFrame([("1", "", False), ("2", "x", False), ("3", "y", True)], "job_id string, tag string, is_mapped boolean")
    assert {tuple(r) for r in A.taxonomy_gaps(jobs, tags).collect()} == {
        ("1", "career", None), ("3", "career", None), ("2", "location", "remote"), ("3", "location", "unknown"), ("4", "location", "unknown"), ("2", "skill", None),
    }
    demand = spark.createDataFrame([("C1", 3, "v1"), ("C2", 4, "v2"), ("C1", None, None)], "career_id string, posting_count long, snapshot_version string")
    matrix = spark.createDataFrame([("C1", "S1")], "career_id string, skill_id string")
    more = spark.createDataFrame([("C2", "S2"), ("C2", "S9")], "career_id string, skill_id string")
    mapping = spark.createDataFrame([("G", "Name", "C1"), ("G", "Name", "C2"), ("G", "Name", "C3")], "career_group_id string, display_name string, career_id string")
    foundation = spark.createDataFrame([("S1", "F1"), ("S2", "F2")], "skill_id string, foundation_skill_id string")
    versions = spark.createDataFrame([("C1", "0.4.0"), ("C2", None)], "career_id string, taxonomy_version string")
    row = A.market_groups(demand, matrix, versions, more, mapping, foundation, "m1").first()
    assert (row.market_signal, row.sample_size, row.foundation_skill_ids, row.snapshot_version, row.taxonomy_version) == ("7 lượt tin trong snapshot; mapping từ C1, C2.", 7, ["F1", "F2"], "v2|m1", "0.4.0")
    lost = mapping.unionByName(spark.createDataFrame([("H", "Other", "C9")], mapping.schema))
    with pytest.raises(Exception, match="no demand rows mapped for H"):
        A.market_groups(demand, matrix, versions, more, lost, foundation, "m1").collect()
    evidence = spark.createDataFrame([("C1", "occupation", "r", "text")], "career_id string, source_type string, reference_id string, text string")
    careers = spark.createDataFrame([("C1", "c"), ("C2", "d")], "career_id string, career_name string")
    assert {r.career_id: r.status for r in C.career_profiles(careers, evidence, demand, "v").collect()} == {"C1": "available", "C2": "insufficient_evidence"}


def test_text_policy(spark):
    said = {
        "SKILL_TRIG": {"technical_id"}, "evidence_a-1": {"technical_id"}, "GAP_X": set(), "Em KÉM quá": {"unsafe"}, "Chain of Thought": {"unsafe"}, "your Confidence": {"engine_field"},
        "Điểm số của em": {"engine_field"}, "đạt 9,5 điểm": {"score_promise"}, "đạt 10 ĐIỂM": {"score_promise"}, "10 điểmx": set(), "cố gắng": set(), "guaranteed": set(),
    }
    df = spark.createDataFrame([(k,) for k in said], "t string")
    got = {k: set() for k in said}
    for r in V.text_policy(df, F.col("t"), "t").collect():
        got[r.key].add(r.detail)
    assert got == said


def test_embedded_postings_anywhere(spark):
    script = '<script type="application/ld+json">{}</script>'
    deep = script.format("{broken") + script.format('{"x":[1,{"y":{"@type":["Thing","JobPosting"],"title":"Deep"}}]}')
    two = script.format('[{"@type":"Organization","z":{"@type":"JobPosting","title":"Inner"}},{"@type":"JobPosting","title":"Later"}]')
    rows = P.extract_jsonld(spark.createDataFrame([(1, deep), (2, two), (3, script.format('{"@type":"Thing"}') + "<title>T</title>")], "id long, html string"), "id", "html").collect()
    assert {r.id: (r.title, r.parser_method) for r in rows} == {1: ("Deep", "json_ld"), 2: ("Inner", "json_ld"), 3: ("T", "page_title")}


def test_medians_and_last_rows(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), (None, 5.0), (None, 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {(r._k0, r.median, r.n) for r in A.spread_median(df, ["k"], F.col("v")).collect()} == {("a", 2.0, 4), (None, 6.0, 2)}
    df = spark.createDataFrame([(1, None, "x"), (1, 3, "y"), (1, 2, "z"), (2, None, "w"), (None, 1, "n"), (None, 2, "m")], "k int, at int, v string")
    assert {(r.k, r.v) for r in D.dedup_last(df, ["k"], ["at", "v"]).collect()} == {(1, "y"), (2, "w"), (None, "m")}
    assert {(r.k, r.v) for r in D.dedup_first(df, ["k"], ["at", "v"]).collect()} == {(1, "z"), (2, "w"), (None, "n")}


def test_empty_batches_and_safe_overwrites(spark, tmp_path):
    from marketloom.operators.lifecycle import empty_state
    from marketloom.sources import tables as S
    from marketloom.streaming.lifecycle import lifecycle_batch, state_path

    key = "source_id string, source_job_id string, content_hash string, collected_at timestamp"
    run = lifecycle_batch(str(tmp_path))
    crawl = spark.createDataFrame([("s", "a", "1", None)], key).withColumn("collected_at", F.lit("2024-01-01").cast("timestamp"))
    run(crawl, 0)
    run(crawl.limit(0), 1)
    states = [spark.read.parquet(state_path(str(tmp_path), k)).collect() for k in (0, 1)]
    assert states[0] == states[1] and len(states[0]) == 1 and empty_state(spark).count() == 0
    path = str(tmp_path / "snap")
    spark.range(5).write.parquet(path)
    assert S.overwrite_if_nonempty(spark.read.parquet(path).filter("id > 2"), path) and spark.read.parquet(path).count() == 2
    assert not S.overwrite_if_nonempty(spark.read.parquet(path).filter("id > 9"), path) and spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("snap")] == ["snap"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_coverage_report_shuffles_no_jobs_for_their_skills(spark):
    rows = [("1", "a", "x", "C", "HN", "ONSITE", "K", True, 0.5, "v1", "text"), ("2", "a", "x", "D", None, "ONSITE", "K", None, None, "v2", " "), (None, "b", "y", None, "HN", "REMOTE", None, False, 1.0, "v1", None), ("4", None, None, None, None, None, "L", True, 0.25, None, "t")]
    columns = "job_id string, source_id string, source_job_id string, career_id string, province string, work_mode string, company_name string, salary_disclosed boolean, overall_confidence double, snapshot_version string, description_clean string"
    jobs, skills = spark.createDataFrame(rows, columns), spark.createDataFrame([("1",), ("1",), (None,), ("4",)], "job_id string")
    states, made = spark.createDataFrame([("active",), (None,)], "lifecycle_status string"), spark.createDataFrame([("a", "2"), ("a", "1")], "source_id string, collector_version string")
    report = A.coverage_report(jobs, skills, states, made, "t")
    r = report.first()
    assert (r.total_current_jobs, r.unique_companies, r.unique_careers, r.unique_provinces, r.duplicate_count, r.jobs_with_mapped_skills) == (4, 2, 2, 1, 1, 2)
    assert (r.remote_job_count, r.unknown_location_count, r.salary_available_count, r.description_available_rate, r.location_mapping_rate_non_remote) == (1, 2, 2, 0.5, 0.3333)
    assert (r.average_extraction_confidence, r.snapshot_versions, r.source_distribution) == (0.5833, ["v1", "v2"], {"a": 2, "b": 1})
    assert r.average_extraction_confidence_by_source == {"a": 0.5, "b": 1.0} and r.collector_versions == {"a": ["1", "2"]}
    none = A.coverage_report(jobs.limit(0), skills, states, made, "t").first()
    assert (none.total_current_jobs, none.salary_available_rate, none.average_extraction_confidence, none.source_distribution, none.snapshot_versions) == (0, None, None, {}, [])
    assert "LeftOuter" not in plan_of(report)


def test_market_groups_need_no_medians_and_demand_no_ids(spark, sf):
    from marketloom.plans.registry import QUERIES

    assert "_upto" not in plan_of(QUERIES["A10_market_groups"](spark, sf))
    jobs = spark.createDataFrame([(None, "s", "1", "C"), ("2", "s", "2", "C"), ("3", "s", "2", "C")], "job_id string, source_id string, source_job_id string, career_id string")
    jobs = jobs.selectExpr("*", "career_id as career_name", "'P' as province", "'M' as work_mode", "'v' as snapshot_version", "'K' as company_name", "true as salary_disclosed", "5D as salary_mid_vnd", "1D as overall_confidence", "current_date() as posted_at", "1 as collected_at", "cast(source_job_id as int) + coalesce(cast(job_id as int), 0) as seq")
    found = A.demand_summary(jobs, "seq")
    assert [(r.posting_count, r.salary_sample_size) for r in found.collect()] == [(1, 2)]
    windows = [line for line in plan_of(found).split("\n") if "Window [row_number" in line]
    assert windows and all("job_id#" not in line.replace("source_job_id#", "") for line in windows)
    assert "isnotnull(job_id" in plan_of(found)


def test_whole_profiles_read_written_postings(spark, sf):
    from marketloom.plans import landing  # noqa: F401
    from marketloom.plans.registry import QUERIES


    plan = plan_of(QUERIES["C11_whole_profiles"](spark, sf))
    assert "l_orderkey" not in plan


def test_a_report_is_worked_out_once_for_all_sinks(spark, sf, monkeypatch):
    from marketloom.plans import landing
    from marketloom.plans.registry import QUERIES

    seen, write = [], landing.S.write_report
    monkeypatch.setattr(landing.S, "write_report", lambda df, path, fmt: (seen.append(plan_of(df)), write(df, path, fmt)))
    QUERIES["S8_report_sinks"](spark, sf).collect()
    assert len(seen) == 2 and not any("Aggregate" in p for p in seen)
