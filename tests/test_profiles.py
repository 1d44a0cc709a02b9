"""Profiles, tags and listing cards by the values that the described rules give; set-similarity matching against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import aggregate as A
from marketloom.operators import matching as M
from marketloom.operators import pages as P
from marketloom.operators import profiles as C


def test_tasks_in_any_script(spark):
    tasks = ["Lập báo cáo", "Lắp báo cáo", "Учить", "Лечить", "lập  báo-cáo!", "…", "---"]
    postings = spark.createDataFrame([("C", k, t) for k, t in enumerate(tasks)], "career_id string, ord int, task string")
    none = spark.createDataFrame([], "career_id string, task_id string, task string, task_type string")
    assert [r.task for r in C.career_tasks(postings, none).orderBy("rank").collect()] == ["Lập báo cáo", "Lắp báo cáo", "Учить", "Лечить", "…"]


def test_preferred_tools_stand_within_names(spark):
    software = spark.createDataFrame([("C", n, False, True) for n in ("Aaa tool", "Microsoft SQL Server", "Python", "R", "Trip")], "career_id string, name string, in_demand boolean, hot boolean")
    rated = spark.createDataFrame([("C", "python", 5.0), ("C", "Reading", 4.0), ("C", "Writing", 4.5), ("C", "None", None)], "career_id string, element_name string, importance double")
    market = spark.createDataFrame([], "career_id string, skill_name string, rank int")
    got = [(r.name, r.origin) for r in C.top_skills_with_fallback(market, software, rated).orderBy("rank").collect()]
    assert got == [("Microsoft SQL Server", "software"), ("Python", "software"), ("R", "software"), ("Aaa tool", "software"), ("Trip", "software"), ("Writing", "rated"), ("Reading", "rated")]


def test_names_of_tags_stand_beside_their_ids(spark):
    tags = spark.createDataFrame([("t",), ("t",), ("u",), ("",), (None,)], "tag string")
    skills = spark.createDataFrame([("t", "S1", "Zeta", "x"), ("t", "S2", "Alpha", None), ("t", "S2", "Alpha", None)], "tag string, skill_id string, skill_name string, category string")
    got = {r.tag: tuple(r)[1:] for r in A.tag_frequency(tags, skills).select("tag", "n", "skill_ids", "skill_names", "skill_categories", "is_mapped").collect()}
    assert got == {"t": (2, "S1 | S2", "Zeta | Alpha", "unspecified | x", True), "u": (1, None, None, None, False)}


def test_a_whole_profile(spark):
    schema = "job_id string, career_id string, company_name string, work_mode string, province string, salary_disclosed boolean, salary_mid_vnd double, is_active boolean"
    jobs = [("1", "C1", "X", "HYBRID", "HN", True, 10.0, True), ("2", "C1", "Y", "ONSITE", None, True, 20.0, True), ("3", "C1", "X", "HYBRID", "HN", False, 99.0, True), ("4", "C1", "Z", "ONSITE", "HCM", True, 1.0, False)]
    demand = [("C1", "HN", "HYBRID", 2, 1, 10.0, 1, "v1"), ("C1", None, "ONSITE", 1, 1, 20.0, 1, "v1")]
    frame = spark.createDataFrame
    found = C.whole_profiles(
        frame([("C1", "Analyst", ["a"]), ("C2", "Nurse", None), ("C3", "Clerk", None)], "career_id string, career_name string, aliases array<string>"),
        frame(jobs, schema),
        frame(demand, "career_id string, province string, work_mode string, posting_count long, unique_company_count long, salary_median_vnd double, salary_sample_size long, snapshot_version string"),
        frame([("C1", 2, "SQL", "market"), ("C1", 1, "Excel", "market")], "career_id string, rank int, name string, origin string"),
        frame([("C1", 1, "Report", "posting")], "career_id string, rank int, task string, origin string"),
        frame([("C2", "Social", 6.0), ("C2", "Social", 7.0), ("C2", "Artistic", 2.0), ("C2", "Unknown", 9.0)], "career_id string, element_name string, data_value double"),
        frame([("C2", "29-1", "Cares."), ("C2", "29-0", "Nurses.")], "career_id string, onetsoc_code string, description string"),
        frame([("C1",), ("C1",), ("C2",)], "career_id string"),
        "0.4.0",
        "2026-01-02",
    )
    a, b, c = found.orderBy("career_id").collect()
    assert (a.posting_count, a.company_count, a.work_modes, a.provinces) == (3, 2, ["HYBRID", "ONSITE"], ["HN"])
    assert (a.salary_median_vnd, a.salary_sample_size, a.evidence_count, a.detail_status) == (15.0, 2, 2, "available")
    assert [s.name for s in a.top_skills] == ["Excel", "SQL"] and [t.task for t in a.typical_tasks] == ["Report"] and a.aliases == ["a"]
    assert [(m.province, m.posting_count, m.unique_company_count, m.salary_median_vnd, m.salary_sample_size, m.snapshot_version) for m in a.market_breakdown] == [("HN", 2, 1, 10.0, 1, "v1"), (None, 1, 1, 20.0, 1, "v1")]
    assert a.overview == "Hồ sơ thị trường của Analyst được tổng hợp từ 3 tin tuyển dụng tại 2 doanh nghiệp trong các nguồn đang theo dõi."
    assert (b.overview, b.riasec_scores, b.riasec_code, b.posting_count, b.detail_status) == ("Nurses. Cares.", {"A": 2.0, "S": 6.5}, "SA", 0, "available")
    assert (c.overview, c.detail_status, c.top_skills, c.market_breakdown, c.salary_median_vnd, c.riasec_code) == ("Chưa có đủ bằng chứng tuyển dụng hiện hành để mô tả chi tiết nghề Clerk.", "insufficient_evidence", [], [], None, "")
    assert (c.profile_version, c.taxonomy_version) == ("0.4.0:2026-01-02", "0.4.0")


CARD = """<div class="card"><a class="logo" href="/cong-ty/sao-mai"><img src="x"></a><h3><a href="/viec-lam/ke-toan-12.html?utm=1">Kế toán trưởng 10 - 15 triệu</a></h3><p>HOT</p>
<p><a href="https://viecoi.vn/cong-ty/sao-mai">Công ty TNHH Sao Mai</a></p><p>12 - 18 triệu</p><p>TP.HCM</p><p>31/12/2024</p><p>Excel, Thuế</p><a href="https://viecoi.vn/viec-lam/ke-toan-12.html">Nộp đơn</a></div>"""


def test_cards_with_links_to_companies(spark):
    other = '<div><a href="/viec-lam/lai-xe-13.html">Lái xe</a><p>Xí nghiệp Vận tải Bình Minh</p><p>Thỏa thuận</p><p>01/02/2024</p></div>'
    page = f'<html><body><a href="/viec-lam/danh-muc-ke-toan-1.html">Kế toán</a><section>{CARD}{other}</section></body></html>'
    found = {r.href: r for r in P.parse_listing(spark.createDataFrame([(1, page), (2, "<p>no links</p>"), (3, None)], "id long, html string"), "id", "html", hosts=("viecoi.vn",)).collect()}
    assert set(found) == {"/viec-lam/ke-toan-12.html", "/viec-lam/lai-xe-13.html"}
    a = found["/viec-lam/ke-toan-12.html"]
    assert (a.job_title_raw, a.company_name_raw, a.salary_raw, a.location_raw, a.deadline_raw, a.skills_raw) == ("Kế toán trưởng 10 - 15 triệu", "Công ty TNHH Sao Mai", "12 - 18 triệu", "TP.HCM", "31/12/2024", '["Excel","Thuế"]')
    assert "Lái xe" not in a.card and a.points == 15


def test_addresses_of_postings():
    assert P.job_path("https://viecoi.vn/viec-lam/x-1.html?a=1#b", hosts=("viecoi.vn",)) == "/viec-lam/x-1.html"
    for other in ("https://else.vn/viec-lam/x-1.html", "/viec-lam/danh-muc-x-1.html", "/cong-ty/x-1.html", "/viec-lam/x.html", "", "mailto:x"):
        assert P.job_path(other, hosts=("viecoi.vn",)) is None


def all_pairs(titles, aliases, least):
    out = {}
    for t in titles:
        if best := max(((M.token_set_ratio(t, a), len(a), -k) for k, a in enumerate(aliases)), default=None):
            if best[0] >= least:
                out[t] = (aliases[-best[2]], round(best[0], 3))
    return out


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9, 1.0])
def test_set_similarity_join_loses_no_pair(spark, least):
    rng = random.Random(int(least * 100))
    letters, words = "abcdé", None
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(40)]

    def near(word):
        k = rng.randrange(len(word) + 1)
        return rng.choice([word[:k] + rng.choice(letters) + word[k:], word[:k] + word[k + 1 :] or "a"])

    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    aliases = list(dict.fromkeys(phrase() for _ in range(90)))
    titles = {" ".join(near(w) if rng.random() < 0.3 else w for w in rng.choice(aliases).split()) for _ in range(90)}
    titles |= {" ".join([*a.split()[1:], rng.choice(words)]) for a in aliases[:40]} | {phrase() for _ in range(40)} | {"", " ", "a b"}
    dim = spark.createDataFrame([(f"I{k}", f"N{k}", a, k, 0) for k, a in enumerate(aliases)], "id string, name string, alias string, entity_ord int, alias_ord int")
    found = M.match_fuzzy(spark.createDataFrame([(t,) for t in titles] + [(None,)], "title string"), dim, least)
    by_id = {f"I{k}": a for k, a in enumerate(aliases)}
    assert {r.title: (by_id[r.id], r.score) for r in found.collect()} == all_pairs(titles, aliases, least)


def test_postings_have_their_own_skills_and_texts_are_not_shuffled(spark):
    from marketloom.operators import postings as J

    raw = spark.createDataFrame([("s", "1", "Clerk", "sql needed"), ("s", "1", "Clerk", "nothing"), ("s", "2", "Clerk", None)], "source string, source_job_id string, title_raw string, description_raw string")
    raw = raw.select("*", *(F.lit(None).cast("timestamp" if c == "collected_at" else "string").alias(c) for c in J.RAW if c not in raw.columns))
    dim = spark.createDataFrame([("S", "SQL", "sql", 0, 0)], "id string, name string, alias string, entity_ord int, alias_ord int")
    done = J.process_postings(raw, dim, dim, dim, "v", markup=False)
    assert sorted((r.source_job_id, [x.skill_id for x in r.skills or []], r.overall_confidence) for r in done.collect()) == [("1", [], 0.425), ("1", ["S"], 0.6), ("2", [], 0.175)]
    plan = done._jdf.queryExecution().executedPlan().toString()
    shuffles = M.extract_skills(raw, "source_job_id", "description_raw", dim, markup=False)._jdf.queryExecution().sparkPlan().toString()
    assert "description_raw" not in "".join(line for line in plan.split("\n") if "Join" in line or "Exchange" in line) and "SortMergeJoin" not in shuffles and "BroadcastHashJoin" in shuffles


def test_many_blocks_and_aliases_that_are_not_sent(spark, monkeypatch):
    """Titles too long for prefixes of letters to tell apart, in blocks of a few, without anything broadcast."""
    monkeypatch.setattr(M, "BLOCK_CHARS", 2_000)
    monkeypatch.setattr(M, "SENT_CHARS", 0)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    aliases = list(dict.fromkeys(" ".join(rng.sample(words, rng.randint(30, 60))) for _ in range(40)))
    titles = {" ".join(w[:-1] + "z" if rng.random() < 0.3 else w for w in a.split()) for a in aliases[:20]} | {" ".join([*a.split(), "more"]) for a in aliases[20:25]}
    dim = spark.createDataFrame([(f"I{k}", f"N{k}", a, k, 0) for k, a in enumerate(aliases)], "id string, name string, alias string, entity_ord int, alias_ord int")
    found = {r.title: (aliases[int(r.id[1:])], r.score) for r in M.match_fuzzy(spark.createDataFrame([(t,) for t in titles], "title string"), dim).collect()}
    assert found == all_pairs(titles, aliases, 0.9) and len(found) >= 20
    inside = spark.createDataFrame([(f"x {' '.join(a.split()[:5])} y",) for a in aliases[:3]] + [(words[0],)], "title string")
    short = dim.selectExpr("id", "name", "substring_index(alias, ' ', 5) as alias", "entity_ord", "alias_ord")
    assert {r.title: r.id for r in M.match_contained(inside, short).collect()} == {f"x {' '.join(a.split()[:5])} y": f"I{k}" for k, a in enumerate(aliases[:3])}


def test_no_cap_on_aliases(spark):
    dim = spark.range(30_000).selectExpr("cast(id as string) as id", "cast(id as string) as name", "'role ' || hex(id) || ' of ' || hex(id * 7919) as alias", "cast(id as int) as entity_ord", "0 as alias_ord")
    titles = spark.createDataFrame([(f"rolle {i:X} of {i * 7919:X}",) for i in (12345, 29_999)] + [("nothing",)], "title string")
    assert {r.id for r in M.match_fuzzy(titles, dim).collect()} == {"12345", "29999"}
    assert {r.id for r in M.match_contained(spark.createDataFrame([(f"senior role {77:X} of {77 * 7919:X} a",)], "title string"), dim).collect()} == {"77"}


def test_aliases_without_a_word_character(spark):
    dim = spark.createDataFrame([("S1", "Plus", "++", 0, 0), ("S2", "C", "c++", 1, 0)], "id string, name string, alias string, entity_ord int, alias_ord int")
    df = spark.createDataFrame([(1, "we use ++ and c++ daily"), (2, "a++b"), (3, "none")], "doc long, t string")
    got = {(r.doc, r.skill_id) for r in M.extract_skills(df, "doc", "t", dim).collect()}
    assert got == {(1, "S1"), (1, "S2")}


def test_three_tiers(spark):
    dim = M.alias_dim(spark.createDataFrame([("A", "Analyst", ["Data Analyst"], 0), ("B", "Teacher", ["School Teacher"], 1)], "id string, name string, aliases array<string>, entity_ord int"))
    titles = [("data analyst",), ("Senior data analyst Hanoi",), ("shool techer",), ("pilot",)]
    got = {r.t: (r.career_id, r.career_confidence) for r in M.match_career(spark.createDataFrame(titles, "t string"), "t", dim).collect()}
    assert got["data analyst"] == ("A", 1.0) and got["Senior data analyst Hanoi"] == ("A", 0.96) and got["pilot"] == (None, 0.0)
    assert got["shool techer"][0] == "B" and 0.9 <= got["shool techer"][1] < 0.96


def test_three_tiers_of_documents(spark, sf):
    import hashlib
    import re

    from marketloom.functions.text import clean_title
    from marketloom.plans.demo import Roles
    from marketloom.plans.registry import LABELLED_TITLES, QUERIES

    roles = Roles(spark, sf)
    dim = sorted((r.entity_ord, r.alias, r.id) for r in M.alias_dim(roles.sql(LABELLED_TITLES)).collect())
    titles = {r.doc_id: r.t for r in roles["posts"].select("doc_id", clean_title("title", False).alias("t")).collect()}
    exact = {}
    for _, alias, i in dim:
        exact.setdefault(alias, i)
    long = sorted(((-len(a), k, a, i) for k, a, i in dim if len(a) >= 8 and " " in a), key=lambda x: x[:2])
    want = {}
    for doc, title in titles.items():
        hit = next((i for _, _, a, i in long if a in title and re.search(r"(?<!\w)" + re.escape(a) + r"(?!\w)", title)), None)
        if title in exact:
            want[doc] = (exact[title], 1.0, "exact")
        elif hit is not None:
            want[doc] = (hit, 0.96, "contained")
        else:
            best = max(((M.token_set_ratio(title, a), len(a), -o, i) for o, a, i in dim), default=(0,))
            want[doc] = (best[3], round(best[0], 3), "fuzzy") if best[0] >= 0.9 else (None, 0.0, "none")
    found = {r.doc_id: (r.career_md5, r.career_confidence) for r in QUERIES["M4_match_career_tiers"](spark, sf).collect()}
    assert found == {d: (None if i is None else hashlib.md5(i.encode()).hexdigest(), c) for d, (i, c, _) in want.items()}
    assert {t for _, _, t in want.values()} == {"exact", "contained", "fuzzy", "none"}


@pytest.mark.parametrize("sent", [0, 40, 5_000_000])
def test_titles_and_aliases_that_hold_one_another(spark, monkeypatch, sent):
    """Whether aliases are sent to the titles or meet them by words, in the plainest case and where marks rule out pairs."""
    monkeypatch.setattr(M, "SENT_CHARS", sent)
    rng = random.Random(5)
    words = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu", "hen"]
    some = lambda n, most: sorted({" ".join(rng.sample(words, rng.randint(1, most))) for _ in range(n)})
    aliases, titles = some(25, 3), [*some(60, 6), "zebra", "ant zebra"]
    dim = spark.createDataFrame([(a, a, a, k, 0) for k, a in enumerate(aliases)], "id string, name string, alias string, entity_ord int, alias_ord int")
    got = {r.title: (r.id, r.score) for r in M.match_fuzzy(spark.createDataFrame([(t,) for t in titles], "title string"), dim, 1.0).collect()}
    want = {}
    for t in titles:
        held = [(-len(a), k, a) for k, a in enumerate(aliases) if set(a.split()) <= set(t.split()) or set(t.split()) <= set(a.split())]
        if held:
            want[t] = (min(held)[2], 1.0)
    assert got == want and 0 < len(want) < len(titles)


def test_a_title_keeps_one_alias_and_pairs_of_short_ones_are_not_shuffled(spark, monkeypatch):
    made = []
    monkeypatch.setattr(M, "kept", lambda df, name, keep=M.kept: made.append((name, keep(df, name))) or made[-1][1])
    titles = spark.range(200).selectExpr("'ant bee cat ' || hex(id) as title")
    dim = spark.createDataFrame([(a, a, a, k, 0) for k, a in enumerate(["ant", "bee", "cat", "ant bee"])], "id string, name string, alias string, entity_ord int, alias_ord int")
    assert {(r.id, r.score) for r in M.match_fuzzy(titles, dim).collect()} == {("ant bee", 1.0)}
    asked, aliases, counts = (dict(made)[n] for n in ("titles", "ranked", "words"))
    plan = M._held(aliases, "rank", asked, "id", counts, lambda df: df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_whole_texts_do_not_meet_the_labels(spark, sf, monkeypatch):
    from marketloom.plans.registry import QUERIES

    seen = []
    monkeypatch.setattr(M, "match_career", lambda df, c, dim, markup: seen.extend([df, dim]) or df.selectExpr("doc_id", "cast(null as string) as career_id", "0D as career_confidence"))
    QUERIES["M4_match_career_tiers"](spark, sf)
    for df in seen:
        assert not any("documents.parquet" in f for f in df.inputFiles())
