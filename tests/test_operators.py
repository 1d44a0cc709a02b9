import datetime

import pytest
from pyspark.sql import functions as F

from marketloom.operators import aggregate as A
from marketloom.operators import checks as V
from marketloom.operators import learner as E
from marketloom.operators import lifecycle as L
from marketloom.operators import lookups as Q
from marketloom.operators import pages as P
from marketloom.operators.postings import adapt_listing, process_postings
from marketloom.operators.matching import alias_dim, extract_skills
from marketloom.sources import tables as S
from marketloom.streaming.lifecycle import lifecycle_stream, state_path

KEY = "source_id string, source_job_id string, content_hash string, collected_at timestamp"


def at(day):
    return datetime.datetime(2024, 1, day)


def crawl(spark, day, **hashes):
    return spark.createDataFrame([("s", k, h, at(day)) for k, h in hashes.items()], KEY)


def merged(spark, state, day, **hashes):
    return L.lifecycle_merge(crawl(spark, day, **hashes), state, F.lit(at(day)))


def by_key(state):
    return {r.source_job_id: r for r in state.collect()}


def test_lifecycle(spark):
    s = merged(spark, L.empty_state(spark), 1, a="1", b="1")
    assert {r.lifecycle_status for r in s.collect()} == {"new"}
    s = merged(spark, s, 2, a="2")
    r = by_key(s)
    assert r["a"].content_changed and r["a"].previous_content_hash == "1" and r["a"].first_seen_at == at(1) and r["a"].last_seen_at == at(2)
    assert r["b"].lifecycle_status == "missing_unconfirmed" and r["b"].is_active and r["b"].last_seen_at == at(1)
    s = merged(spark, merged(spark, s, 3, a="2"), 4, a="2")
    r = by_key(s)
    assert r["b"].lifecycle_status == "inactive" and not r["b"].is_active and r["b"].inactive_at == at(4) and not r["a"].content_changed
    r = by_key(merged(spark, merged(spark, s, 5, a="2"), 6, a="2", b="9"))
    assert r["b"].reactivated and r["b"].lifecycle_status == "seen" and r["b"].inactive_at is None and r["b"].consecutive_missing_runs == 0


def test_invalid_rows(spark):
    good, bad = L.mark_invalid(crawl(spark, 1, a="1", c="1"), F.col("source_job_id") == "c", F.lit(at(1)))
    s = L.with_invalid(L.lifecycle_merge(good, L.empty_state(spark), F.lit(at(1))), bad)
    assert by_key(s)["c"].lifecycle_status == "invalid"
    later = by_key(merged(spark, s, 2, a="1"))
    assert later["c"].lifecycle_status == "invalid" and not later["c"].is_active
    again = merged(spark, s, 2, a="1", c="1").filter("source_job_id = 'c'").collect()
    assert len(again) == 1 and again[0].lifecycle_status == "new"


def test_keys(spark):
    with pytest.raises(ValueError):
        L.prepare_keys(spark.range(1))
    with pytest.raises(Exception):
        L.prepare_keys(spark.createDataFrame([("s", None)], "source_id string, source_job_id string")).collect()
    assert L.observed_at(crawl(spark, 3, a="1")).first()[0] == at(3)


def test_lifecycle_stream(spark, tmp_path):
    source = tmp_path / "in"
    for day, hashes in ((1, {"a": "1", "b": "1"}), (2, {"a": "2"})):
        crawl(spark, day, **hashes).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(KEY).parquet(str(source))
        lifecycle_stream(stream, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination(90)
    r = by_key(spark.read.parquet(state_path(str(tmp_path / "state"), 1)))
    assert r["a"].content_changed and r["b"].lifecycle_status == "missing_unconfirmed"


def test_demand_keeps_null_places(spark):
    schema = "job_id string, source_id string, source_job_id string, career_id string, career_name string, province string, work_mode string, snapshot_version string, company_name string, salary_mid_vnd double, salary_disclosed boolean, posted_at date, collected_at timestamp, overall_confidence double, is_active boolean, lifecycle_status string"
    row = lambda i, p, pay, known, active=True, status=None: (f"j{i}", "s", f"{i}", "C", "c", p, "ONSITE", "v", "co", pay, known, None, at(1), 0.5, active, status)
    jobs = spark.createDataFrame([row(1, None, 10.0, True), row(2, None, 20.0, True), row(3, None, 99.0, False), row(4, "HN", 5.0, True, False), row(5, "HN", 5.0, True, True, "invalid"), row(6, "HN", None, None)], schema)
    got = {r.province: r for r in A.demand_summary(jobs).collect()}
    assert got[None].posting_count == 3 and got[None].salary_median_vnd == 15.0 and got[None].salary_sample_size == 2
    assert got["HN"].posting_count == 1 and got["HN"].salary_median_vnd is None


def test_postings_from_a_listing(spark):
    dim = lambda *rows: alias_dim(spark.createDataFrame([(i, n, list(a), k) for k, (i, n, *a) in enumerate(rows)], "id string, name string, aliases array<string>, entity_ord int"))
    raw = spark.createDataFrame(
        [("Viecoi", "v", "1", None, "[HN] Tuyển Chuyên viên phân tích dữ liệu", "Công ty A", "Hà Nội", "10-12 triệu", '["SQL", "Excel "]', "Thẻ", "2024-01-02 00:00:00")],
        "source string, source_id string, source_job_id string, source_url string, job_title_raw string, company_name_raw string, location_raw string, salary_raw string, skills_raw string, card_text_raw string, fetched_at string",
    )
    careers = dim(("C1", "Data Analyst", "data analyst", "chuyên viên phân tích dữ liệu"))
    places = dim(("Hà Nội", "Hà Nội", "hà nội"))
    row = process_postings(adapt_listing(raw), careers, dim(("S1", "SQL", "sql"), ("S2", "Excel", "excel")), places, "v1").first()
    assert (row.career_id, row.career_confidence, row.province, row.salary_min_vnd, row.duplicate_count) == ("C1", 1.0, "Hà Nội", 10_000_000, 1)
    assert [s.skill_id for s in row.skills] == ["S1", "S2"]


def test_skill_levels(spark):
    dim = alias_dim(spark.createDataFrame([("S1", "SQL", ["sql", "t-sql"], 0), ("S2", "Excel", ["excel"], 1), ("S3", "React", ["react.js"], 2)], "id string, name string, aliases array<string>, entity_ord int"))
    df = spark.createDataFrame([(1, "Biết SQL. Excel không bắt buộc; ưu tiên React.js\nsqlđ"), (2, "MySQL"), (3, None)], "doc long, t string")
    got = {(r.doc, r.skill_id): (r.requirement_level, r.raw_mention) for r in extract_skills(df, "doc", "t", dim).collect()}
    assert got == {(1, "S1"): ("required", "SQL"), (1, "S2"): ("not_required", "Excel"), (1, "S3"): ("preferred", "React.js")}


def test_abilities_stay_in_bounds(spark):
    schema = "student_id string, evidence_id string, source_type string, skill_id string, normalized_value double, confidence double, observed_at timestamp"
    rows = [("a", "1", "self_report", "S", 0.4, 1.0, None), ("b", "2", "assessment", "S", 0.0, 1.0, None), ("b", "3", "self_report", "S", 1.0, 1.0, None), ("b", "4", "self_report", "INTEREST_X", 1.0, 1.0, None)]
    got = {r.student_id: r for r in E.ability_profile(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].confidence == round(0.4 / 2 * 0.6, 6)
    assert got["b"].estimated_level == round(0.4 / 1.4, 6) and got["b"].confidence == round(1.4 / 2 * 0.25, 6)


def test_asof_takes_the_latest_before(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "u string, at timestamp, attempt_id string, value double")
    posts = rows(("x", at(5), "p1", 0.9), ("x", at(1), "p2", 0.9), ("y", at(9), "p3", 0.9))
    bases = rows(("x", at(2), "b1", 0.1), ("x", at(5), "b2", 0.2), ("x", at(5), "b3", 0.3), ("x", at(6), "b4", 0.4))
    got = {(r.posttest_id, r.baseline_id) for r in E.asof_baseline(posts, bases, ["u"]).collect()}
    assert got == {("p1", "b3")}


def test_page_operators(spark):
    page = "<h2>Mô tả công việc</h2><ul><li>Build data pipelines daily</li><li>build DATA pipelines daily!</li><li>short</li></ul><h2>Yêu cầu</h2><ul><li>Five years of experience</li></ul>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "just text")], "id long, html string")
    blocks = P.html_blocks(df, "id", "html")
    assert {r.id for r in blocks.collect()} == {1, 3}
    assert [r.task for r in P.typical_tasks(blocks, "id").collect()] == ["Build data pipelines daily"]
    embedded = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev","description":"d"}]}</script><title>T</title>'
    rows = P.extract_jsonld(spark.createDataFrame([(1, embedded), (2, "<title> T </title>"), (3, None)], "id long, html string"), "id", "html").collect()
    assert [(r.title, r.parser_method) for r in sorted(rows)] == [("Dev", "json_ld"), ("T", "page_title"), (None, "none")]
    files = spark.createDataFrame([(1, b"a@b.vn\nx", "a.txt"), (2, b"\xff\xfe", "b.txt"), (3, b"x", "c.pdf")], "id long, content binary, name string")
    got = {r.id: (r.status, r.error, r.emails) for r in P.extract_documents(files, "id", "content", "name").collect()}
    assert got == {1: ("completed", None, "a@b.vn"), 2: ("failed", "not UTF-8", None), 3: ("failed", "unsupported type", None)}


def test_answers_and_submissions(spark):
    q = spark.createDataFrame([("q1", "choice", ["a", "b"], None, None, None), ("q2", "allocation", ["x", "y"], None, None, None), ("q3", "number", None, 1.0, 5.0, None), ("q4", "ranking", ["x", "y"], None, None, None)], "question_id string, type string, options array<string>, low double, high double, max_words int")
    a = spark.createDataFrame([(1, "q1", "a", None), (2, "q1", "c", None), (3, "q2", None, ["x=60", "y=40"]), (4, "q2", None, ["x=60", "y=30"]), (5, "q3", "4", None), (6, "q3", "six", None), (7, "q4", None, ["y", "x"]), (8, "q4", None, ["y", "y"])], "answer_id long, question_id string, value string, items array<string>")
    assert {r.key for r in V.valid_answers(a, q).collect()} == {"2", "4", "6", "8"}
    answers = spark.createDataFrame([("s", "q1", "yes"), ("s", "q2", "hidden"), ("s", "q9", "?")], "submission_id string, question_id string, value string")
    conditions = spark.createDataFrame([("q2", "q1", "equals", "no"), ("q3", "q1", "in", "yes|maybe")], "question_id string, depends_on string, operator string, operand string")
    shown = V.visible(conditions, answers)
    assert {r.question_id: r.is_visible for r in shown.collect()} == {"q2": False, "q3": True}
    asked = spark.createDataFrame([("q1", True), ("q2", True), ("q3", True)], "question_id string, required boolean")
    assert {(r.rule, r.key) for r in V.submission(answers, asked, shown).collect()} == {("submission:unknown", "s/q9"), ("submission:hidden", "s/q2"), ("submission:missing", "s/q3")}


def test_taxonomy_and_packages(spark):
    t = spark.createDataFrame([("SKILL_A", "A", ["a", "A "]), ("X", "", []), ("SKILL_A", "B", ["b"])], "id string, name string, aliases array<string>")
    assert {r.rule for r in V.taxonomy_structure(t, "SKILL_").collect()} == {"unique:id", "taxonomy:prefix", "not_blank:name", "taxonomy:no_alias", "taxonomy:repeated_alias"}
    p = spark.createDataFrame([("p", 2, 1.0, 2)], "package_id string, n_questions int, total_score double, max_difficulty int")
    i = spark.createDataFrame([("p", "1", 0.5, 3, "f", ["a", "b", "c"], "a"), ("p", "2", 0.4, 1, "g", ["a", "a", "b"], "z")], "package_id string, item_id string, score double, difficulty int, fingerprint string, options array<string>, answer string")
    assert {r.rule for r in V.package_invariants(p, i, i.filter("fingerprint = 'g'")).collect()} == {"package:score", "package:difficulty", "package:reused", "package:options"}


def test_sources(spark, tmp_path):
    payload = '{"jobs":[{"id":1,"title":"A","location":{"name":"HN"},"departments":[{"name":" x "},{"name":"y"}],"content":"c"},{"id":1,"title":"B"},{"id":2,"title":"C","location":"HCM"}]}'
    board = spark.createDataFrame([("b", "2024-01-01", payload)], "source_id string, fetched_at string, payload string")
    rows = {r.source_job_id: r for r in S.flatten_board_payload(board, "payload").collect()}
    assert rows["1"].title_raw == "A" and rows["1"].industry_raw == "x | y" and rows["1"].location_raw == "HN" and rows["2"].location_raw == "HCM"
    jobs = spark.createDataFrame([("j", "v1", [(1,)])], "job_id string, snapshot_version string, skills array<struct<a int>>")
    root = str(tmp_path / "warehouse")
    S.publish(spark, {"jobs_clean": jobs}, root)
    assert S.read_table(spark, root, "jobs_clean").collect() == jobs.collect()
    with pytest.raises(ValueError):
        S.read_table(spark, root, "nope")
    path = str(tmp_path / "snap")
    assert S.overwrite_if_nonempty(jobs, path) and not S.overwrite_if_nonempty(jobs.limit(0), path)
    assert S.read_snapshot(spark, path, ["job_id"]).count() == 1
    with pytest.raises(ValueError):
        S.read_snapshot(spark, path, ["missing"])
    S.write_report(jobs, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().skills == '[{"a":1}]'
    fallback = spark.createDataFrame([("G", 1)], "career_group_id string, sample_size int")
    assert S.market_snapshot(spark, str(tmp_path / "none"), ["x"], fallback).first().data_mode == "fallback"
    assert S.market_snapshot(spark, path, ["job_id"], fallback).first().data_mode == "observed"
    (tmp_path / "ref.json").write_text('{"row":[{"onetsoc_code":"1","title":"t","description":"d"}]}')
    assert S.read_reference_rows(spark, str(tmp_path / "ref.json"), "occupation").first().title == "t"
    (tmp_path / "tax.json").write_text('{"taxonomy_version":"1","skills":[{"skill_id":"S","canonical_name":"N","aliases":["a"]}]}')
    assert tuple(S.read_taxonomy(spark, str(tmp_path / "tax.json"), "skills").first()) == ("S", "N", ["a"], 0, "1")


def test_a_roster_deals_the_pairs_of_one_key_to_several_tasks(spark):
    users = spark.range(400).select(F.col("id").alias("u"), F.lit(1).alias("t"), F.lit("a").alias("c")).coalesce(1)
    odd = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), (-1, None, "a"), (-2, 1, None), (-3, 9, "a")], "u long, t int, c string")
    users = users.unionByName(odd).coalesce(1)
    profiles = spark.createDataFrame([(1, "a", 7, None), (1, "a", 7, None), (1, "a", None, "x"), (None, "a", 1, "x"), (8, "a", 1, "x")], "t int, c string, p int, n string")
    got = Q.roster(users, profiles, ["t", "c"])
    want = users.join(profiles, ["t", "c"])
    assert got.schema == want.schema and got.count() == 402 * 3 and not got.exceptAll(want).count() and not want.exceptAll(got).count()
    held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < 0.6 * sum(held)
    keys = Q.roster(users, profiles.select("t", "c"), ["t", "c"])
    assert keys.columns == ["t", "c", "u"] and keys.count() == 402 * 3
