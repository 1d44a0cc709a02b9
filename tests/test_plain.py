"""Registered queries without SQL against plain Python over the same tables."""

import html
import json
import re
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from marketloom.operators import matching as M
from marketloom.plans.registry import QUERIES

CHECKED = {
    "T1_clean_text", "T2_match_text", "T8_extraction_text", "P1_html_blocks", "P3_parse_listing", "P5_typical_tasks", "M3_match_fuzzy", "M4_match_career",
    "M4_match_career_tiers", "Q13_distinct_questions",  # in test_profiles.py and test_versions.py
    "M9_process_postings", "E22_snapshot", "Q13_sample_balanced", "V12_report_reconciled", "L3_lifecycle_merge_whole", "L4_mark_invalid_whole", "L5_status_counts_whole",
}


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


class Texts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def squeezed(text):
    return re.sub(r"\s+", " ", text).strip()


def test_texts_of_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    clean = {r.page_id: r.text for r in rows(spark, sf, "T1_clean_text")}
    match = {r.page_id: r.text for r in rows(spark, sf, "T2_match_text")}
    extracted = {r.page_id: r.text for r in rows(spark, sf, "T8_extraction_text")}
    assert clean.keys() == match.keys() == extracted.keys() == pages.keys()
    for i, page in pages.items():
        parser = Texts()
        parser.feed(html.unescape(page or ""))
        words = set(re.findall(r"\w{3,}", " ".join(parser.parts)))
        assert words <= set(re.findall(r"\w{3,}", clean[i])) and "<p>" not in clean[i] and clean[i] == squeezed(clean[i])
        assert match[i] == clean[i].lower() and squeezed(extracted[i]) == squeezed(clean[i]) or extracted[i].count("\n") > 0


def test_blocks_and_tasks(spark, sf):
    blocks = {}
    for r in sorted(rows(spark, sf, "P1_html_blocks"), key=lambda r: (r.page_id, r.pos)):
        blocks.setdefault(r.page_id, []).append(r)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for i, mine in blocks.items():
        plain = squeezed(re.sub(r"<[^>]+>", " ", html.unescape(pages[i])))
        for a, b in zip(mine, mine[1:]):
            assert a.key != b.key and a.pos < b.pos
        assert all(squeezed(b.block).split(" ")[0] in plain for b in mine)
    tasks = {}
    for r in rows(spark, sf, "P5_typical_tasks"):
        tasks.setdefault(r.page_id, {})[r["rank"]] = r.task
    for i, mine in tasks.items():
        assert sorted(mine) == list(range(1, len(mine) + 1)) and len(mine) <= 8 and all(12 <= len(t) <= 350 for t in mine.values())
        shown = [b.block.strip(" •-–—\t") for b in blocks[i] if b.tag == "li"]
        assert set(mine.values()) <= set(shown)
    assert tasks


def ratio(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a)):
        for y in range(len(b)):
            m[x + 1][y + 1] = m[x][y] + 1 if a[x] == b[y] else max(m[x][y + 1], m[x + 1][y])
    return 2 * m[-1][-1] / (len(a) + len(b)) if a or b else 1.0


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    if both and not (left and right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([ratio(one, two)] + ([ratio(both, one), ratio(both, two)] if both else []))


def fuzzy(title, aliases):
    best = max(((token_set(title, a), len(a), -k) for k, a in enumerate(aliases)), default=(0, 0, 0))
    return (title, aliases[-best[2]], round(best[0], 3)) if best[0] >= 0.9 else None


def test_fuzzy_titles(spark, sf):
    names = sorted({r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()})
    want = {fuzzy(n + "s", names) for n in names} - {None}
    assert {(r.title, r.id, r.score) for r in rows(spark, sf, "M3_match_fuzzy")} == want and want
    titles = ["senior data engineer", "enginer data", "data", "", "xyz", "data engineers", "the chief"]
    aliases = ["data engineer", "chief executive", "engineer data lead", "d a t a"]
    dim = spark.createDataFrame([(a, a, a, k, 0) for k, a in enumerate(aliases)], "id string, name string, alias string, entity_ord int, alias_ord int")
    found = M.match_fuzzy(spark.createDataFrame([(t,) for t in titles], "title string"), dim).collect()
    assert {(r.title, r.id, r.score) for r in found} == {fuzzy(t, aliases) for t in titles} - {None}
    for a, b in (("kitten", "sitting"), ("", "x"), ("abc", "abc"), ("ab" * 40, "ba" * 37)):
        assert M.indel_ratio(a, b) == pytest.approx(ratio(a, b))
    assert SequenceMatcher(None, "abcd", "abcd").ratio() == M.indel_ratio("abcd", "abcd")
    with pytest.raises(ValueError):
        M.match_fuzzy(dim.select(F.col("alias").alias("title")), dim, least=0.4)


def test_career_of_titles_and_postings(spark, sf):
    from marketloom.plans.registry import ALIASES

    posts = {r.doc_id: squeezed((r.text or "").split("\n")[0]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: r for r in rows(spark, sf, "M4_match_career")}
    assert found.keys() == posts.keys()
    for i, r in found.items():
        held = [a for a in ALIASES if re.search(rf"(?<!\w){re.escape(a)}(?!\w)", posts[i].lower())]
        if r.career_confidence == 1.0 and r.career_id:
            assert r.career_id in held or set(r.career_id.split()) <= set(posts[i].lower().split()) or set(posts[i].lower().split()) <= set(r.career_id.split())
        if r.career_id is None:
            assert r.career_confidence == 0.0
    postings = rows(spark, sf, "M9_process_postings")
    assert len(postings) == len(posts) and len({p.job_id for p in postings}) <= len(posts)
    for p in postings:
        assert p.job_id.startswith("job_") and len(p.job_id) == 20 and p.dedup_group_id == "dup_" + p.content_hash[:16]
        assert p.seniority_level and p.work_mode in ("REMOTE", "HYBRID", "ONSITE", "UNSPECIFIED") and p.is_active and p.snapshot_version == "v1"
        assert p.salary_disclosed == (p.salary_mid_vnd is not None or p.salary_min_vnd is not None or p.salary_max_vnd is not None)
    shared = {}
    for p in postings:
        shared[p.content_hash] = shared.get(p.content_hash, 0) + 1
    assert all(p.duplicate_count == shared[p.content_hash] for p in postings)


def test_snapshots_and_samples(spark, sf):
    students = {str(r.user_id) for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    found = rows(spark, sf, "E22_snapshot")
    assert {r.student_id for r in found} <= students and found
    assert all(r.snapshot_id.startswith("SNAP_") and r.snapshot_id != r.previous_snapshot_id and r.skills > 0 for r in found)
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sample = rows(spark, sf, "Q13_sample_balanced")
    for lang in set(docs.values()):
        mine = [r for r in sample if r.lang == lang]
        assert sorted(r["rank"] for r in mine) == list(range(1, 11)) and all(docs[r.doc_id] == lang for r in mine)
    report = rows(spark, sf, "V12_report_reconciled")
    assert {r.rule for r in report} == {"range:location_rate"} and len(report) == 2


def test_a_listing(spark):
    from marketloom.operators.pages import parse_listing

    card = """<div class="card"><a href="/viec-lam/ke-toan-12.html">Kế toán trưởng 10 - 15 triệu</a><p>HOT</p><p>Công ty TNHH Sao Mai</p>
    <p>12 - 18 triệu</p><p>Quận 1 - TP.HCM</p><p>Hạn nộp 31/12/2024</p><p>Excel, Thuế , excel, Misa...</p><p>Kế toán trưởng 10 - 15 triệu</p></div>"""
    other = """<div><a href="/viec-lam/lai-xe-13.html">Lái xe</a><p>Xí nghiệp Vận tải Bình Minh</p><p>Thỏa thuận</p><p>Tây Nguyên</p><p>01/02/2024</p><p>Bằng C</p></div>"""
    page = f"<html><body><section>{card}{other}</section></body></html>"
    found = {r.href: r for r in parse_listing(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html").collect()}
    a, b = found["/viec-lam/ke-toan-12.html"], found["/viec-lam/lai-xe-13.html"]
    assert (a.job_title_raw, a.salary_raw, a.deadline_raw, a.location_raw) == ("Kế toán trưởng 10 - 15 triệu", "12 - 18 triệu", "31/12/2024", "Quận 1 - TP.HCM")
    assert a.company_name_raw == "Công ty TNHH Sao Mai" and json.loads(a.skills_raw) == ["Excel", "Thuế", "Misa"]
    assert (b.salary_raw, b.location_raw, b.company_name_raw) == ("Thỏa thuận", "Tây Nguyên", "Xí nghiệp Vận tải Bình Minh") and json.loads(b.skills_raw) == ["Bằng C"]


def test_listing_query_runs_on_every_page(spark, sf):
    hrefs = {r.href for r in rows(spark, sf, "P3_parse_listing")}
    pages = [r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert all(any(h in p for p in pages) for h in hrefs)
