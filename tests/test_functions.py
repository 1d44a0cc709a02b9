import datetime
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.functions import normalize as N
from marketloom.functions import text as T
from marketloom.operators.matching import indel_ratio, token_set_ratio


def one(spark, make, *values):
    """The values of a one-column expression over literal rows."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", make("x").alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    got = one(spark, T.clean_text, "<p>Lương &amp; thưởng</p><p>tốt</p>", None, "a​b  c", "é", "&lt;b&gt;x", "<script>no</script>yes <style>q</style>", "plain")
    assert got == ["Lương & thưởng tốt", "", "a b c", "é", "x", "yes", "plain"]
    assert one(spark, T.extraction_text, "<ul><li>a  b</li><li>c</li></ul>", None) == ["a b\nc", ""]


def test_company_and_titles(spark):
    assert one(spark, T.normalize_company, "Công ty TNHH  ABC", "CPJ jsc", None) == ["abc", "cpj", ""]
    titles = ["[HCM] Gấp tuyển Nhân viên SQL (Lương 20 triệu)", "Tuyển 5 bạn Kế toán", "Data Analyst - 10 - 15 triệu gross - HN", None]
    assert one(spark, T.clean_title, *titles) == ["nhân viên sql", "tuyển 5 bạn kế toán".replace("tuyển 5 bạn ", ""), "data analyst", ""]


def test_folding(spark):
    assert one(spark, T.fold_accents, "Đồng Nai", "CAFÉ", "é", None) == ["đong nai", "cafe", "e", ""]
    assert one(spark, T.slug, " Kỹ năng Đọc! ", "---", None) == ["ky_nang_doc", "", ""]
    assert one(spark, lambda c: T.prefixed_token("SKILL", c), "Phân tích", "!") == ["SKILL_PHAN_TICH", None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aàáảãạăằâầđeèéêềiìoòôồơờuùưừyỳAÀĐ x", max_size=12), min_size=1, max_size=12))
def test_folding_equals_the_definition(spark, values):
    want = ["".join(c for c in unicodedata.normalize("NFD", v.lower()) if unicodedata.category(c) != "Mn") for v in values]
    assert one(spark, T.fold_accents, *values) == want


def test_keys_and_lines(spark):
    assert one(spark, T.block_key, "“A” – b  C", None) == ['"a" - b c', ""]
    assert one(spark, T.squeezed_or_null, " a  b ", "  ", None) == ["a b", None, None]
    assert one(spark, T.distinct_lines, "a\nB\n A \n\nb\nc", None) == ["a\nB\nc", ""]


def test_metadata_trims_spaces_only(spark):
    made = T.document_metadata("x")
    df = spark.createDataFrame([("0 first 0\n  1 second 1 \n \nthird",), (None,)], "x string")
    assert [tuple(r) for r in df.select(made["line_count"], made["preview"]).collect()] == [(3, "0 first 0\n1 second 1\nthird"), (0, "")]


def test_urls(spark):
    canonical = lambda c: T.canonical_job_url(c, "https://viec.vn/", ["viec.vn", "www.viec.vn"])
    got = one(spark, canonical, "/viec-lam/ke-toan-12.html?x=1#y", "//www.viec.vn/viec-lam/a-9.html", "https://other.vn/viec-lam/a-9.html", "/danh-muc-x/viec-lam/a-9.html", "/viec-lam/no.html", None)
    assert got == ["https://viec.vn/viec-lam/ke-toan-12.html", "https://www.viec.vn/viec-lam/a-9.html", None, None, None, None]
    ids = one(spark, T.id_from_url, "https://x/12.html", "https://x/a-j34.html", "other")
    assert ids[:2] == ["12", "34"] and len(ids[2]) == 16


def test_salaries(spark):
    texts = ["10 - 15 triệu", "Từ 8tr", "up to 2.5M", "12 triệu", "Thỏa thuận", None, "7,5–9 tr", "hello"]
    got = [tuple(x) for x in one(spark, N.salary, *texts)]
    m = 1_000_000
    assert got == [
        (10 * m, 15 * m, 12.5 * m, True), (8 * m, None, None, True), (None, 2_500_000, None, True), (12 * m, 12 * m, 12.0 * m, True),
        (None, None, None, False), (None, None, None, False), (7_500_000, 9 * m, 8_250_000.0, True), (None, None, None, False),
    ]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(1, 90)), min_size=1, max_size=10))
def test_salary_ranges(spark, pairs):
    got = one(spark, lambda c: N.salary(c, markup=False), *[f"{a}-{b} triệu" for a, b in pairs])
    assert [(x.min_vnd, x.max_vnd) for x in got] == [(a * 1_000_000, b * 1_000_000) for a, b in pairs]


def test_other_fields(spark):
    assert one(spark, N.seniority, "Fresher 3 năm", "intern", "dưới 1 năm", "1-2 năm", "5", "3 - 8", "", None) == ["fresher", "intern", "junior", "junior", "mid", "senior", "unknown", "unknown"]
    assert one(spark, N.education, "Đại học", "Cao đẳng trở lên", "", "không yêu cầu", "khác") == ["university_or_above", "college_or_above", "no_formal_requirement", "no_formal_requirement", "unknown"]
    day = lambda c: N.posted_date(c, F.lit("2024-03-10").cast("timestamp"))
    d = datetime.date
    assert one(spark, day, "Hôm nay", "hôm qua", "3 ngày trước", "05/02/2024", "2024-01-31", "khi nào", None) == [d(2024, 3, 10), d(2024, 3, 9), d(2024, 3, 7), d(2024, 2, 5), d(2024, 1, 31), None, None]
    assert one(spark, N.experience_years, "3+ years, at least 2 yrs", "5 năm", "no", None) == [2.0, 5.0, None, None]
    assert one(spark, lambda c: N.work_mode(c, F.lit(None).cast("string")), "Hybrid, remote", "Hybrid", "on-site", None) == ["REMOTE", "HYBRID", "ONSITE", "UNSPECIFIED"]


def test_embedded_posting(spark):
    text = '{"baseSalary":{"currency":"VND","value":{"minValue":5,"maxValue":9,"unitText":"MONTH"}},"jobLocation":{"address":{"streetAddress":"1 A","addressRegion":"HN"}}}'
    df = spark.createDataFrame([(text,)], "x string").select(*(c.alias(k) for k, c in N.posting_salary_location("x").items()))
    assert tuple(df.first()) == ("VND", 5.0, 9.0, "MONTH", "1 A, HN")


def test_hashes(spark):
    import hashlib

    want = hashlib.sha256("kế toán|abc|hà nội|x".encode()).hexdigest()
    df = spark.createDataFrame([("Kế  toán", "Công ty ABC", "Hà Nội", "<p>x</p>")], "a string, b string, c string, d string")
    assert df.select(T.content_hash("a", "b", "c", "d")).first()[0] == want
    job = df.select(T.job_id(F.lit("s"), F.lit(""), F.lit(None).cast("string"), F.lit("h"))).first()[0]
    assert job == "job_" + hashlib.sha1(b"s|h").hexdigest()[:16]


@pytest.mark.parametrize("a,b,low,high", [("data analyst", "analyst data", 1, 1), ("senior data analyst", "data analyst", 1, 1), ("data analyst", "data analysts", 0.95, 1), ("kế toán", "lập trình", 0, 0.6), ("", "x", 0, 0)])
def test_token_set_ratio(a, b, low, high):
    assert low <= token_set_ratio(a, b) <= high and indel_ratio(a, a) == 1


def test_pages_are_stripped_by_slices_of_a_batch():
    import pyarrow as pa

    from marketloom.functions import text

    got = text.by_slices(pa.array(["<p>a</p>", None, "b &amp; <i>c</i>"] * 70), " ")
    assert got.to_pylist() == ["a", None, "b &  c"] * 70 and text.SLICE_ROWS < 210
    assert text.by_slices(pa.array([], pa.string()), " ").to_pylist() == []
