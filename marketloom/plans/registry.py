"""All registered queries over the driver's tables, and their equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import normalize as N
from marketloom.functions import text as T
from marketloom.operators import aggregate as A
from marketloom.operators import checks as V
from marketloom.operators import dedup as D
from marketloom.operators import learner as E
from marketloom.operators import lifecycle as L
from marketloom.operators import lookups as Q
from marketloom.operators import matching as M
from marketloom.operators import pages as P
from marketloom.operators import postings as J
from marketloom.operators import profiles as C
from marketloom.plans.demo import Roles, role_sql
from marketloom.sources.tables import career_code_map, jsonify_complex, read_snapshot, split_jobs_skills
from marketloom.sources.versions import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
JOBS, SKILLS, EVIDENCE, STUDENTS, RESULTS, POSTS = (role_sql(r) for r in ("jobs", "skills", "evidence", "students", "results", "posts"))


def query(name: str, sql: str | None = None):
    """Register a function of ``Roles`` and its SQL."""

    def add(f: Callable[[Roles], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last bits."""
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


# aggregates ---------------------------------------------------------------------------------------------------------

LATEST = f"select * from ({JOBS}) j where is_active qualify row_number() over (partition by source_id, source_job_id order by collected_at desc, seq desc) = 1"
DEMAND = f"""
select career_id, career_name, province, work_mode, snapshot_version, count(job_id) as posting_count, count(distinct company_name) as unique_company_count,
       median(case when salary_disclosed then salary_mid_vnd end) as salary_median_vnd, count(case when salary_disclosed then salary_mid_vnd end) as salary_sample_size,
       avg(overall_confidence) as average_confidence, min(posted_at) as data_from, max(posted_at) as data_to
from ({LATEST}) t where career_id is not null group by 1, 2, 3, 4, 5
"""
MATRIX = f"""
select career_id, province, work_mode, skill_id, skill_name, count(*) as skill_posting_count from (
  select skill_id, min(struct_pack(career_id := career_id, province := coalesce(province, ''), work_mode := work_mode, skill_name := skill_name)) as v
  from ({SKILLS}) s where requirement_level in ('required', 'preferred', 'mentioned') group by dedup_group_id, skill_id
) g, lateral (select v.career_id, nullif(v.province, '') as province, v.work_mode, v.skill_name) x group by all
"""


@query("A1_demand_summary", f"select * replace (round(average_confidence, 8) as average_confidence, round(salary_median_vnd, 8) as salary_median_vnd) from ({DEMAND}) d")
def _(r):
    return rounded(A.demand_summary(r["jobs"], "seq"))


@query("A2_skill_matrix", MATRIX)
def _(r):
    return A.skill_matrix(r["skills"])


@query("A3_skill_share", f"select m.*, d.posting_count, round(skill_posting_count / d.posting_count, 8) as share_of_career_jobs from ({MATRIX}) m left join ({DEMAND}) d on m.career_id is not distinct from d.career_id and m.province is not distinct from d.province and m.work_mode is not distinct from d.work_mode")
def _(r):
    return rounded(A.skill_share(A.skill_matrix(r["skills"]), A.demand_summary(r["jobs"], "seq")))


@query("A4_quality_report", f"""
select count(*) as row_count, count(distinct content_hash) as distinct_hashes, count(*) - count(distinct (source_id, source_job_id)) as duplicate_identities, count(career_id) as mapped_careers,
       count(province) as mapped_locations, count(*) filter (work_mode = 'REMOTE') as remote_jobs, count(*) filter (salary_disclosed) as salary_disclosed, round(avg(overall_confidence), 3) as mean_confidence,
       string_agg(distinct source_id, ',' order by source_id) as sources, string_agg(distinct snapshot_version, ',' order by snapshot_version) as snapshot_versions, '0.4.0' as taxonomy_version from ({JOBS}) j""")
def _(r):
    return A.quality_report(r["jobs"], "0.4.0")


COVERAGE = """count(*) as job_count, count(*) filter (work_mode = 'REMOTE') as remote_count, round(count(career_id) / count(*), 4) as career_rate,
       round(count(*) filter (work_mode <> 'REMOTE' and province is not null) / nullif(count(*) filter (work_mode <> 'REMOTE'), 0), 4) as location_rate,
       round(count(*) filter (s.job_id is not null) / count(*), 4) as skill_rate, round(count(*) filter (salary_disclosed) / count(*), 4) as salary_rate, round(avg(overall_confidence), 4) as mean_confidence"""
WITH_SKILL = f"({JOBS}) j left join (select distinct job_id from ({SKILLS}) x) s on j.job_id = s.job_id"


@query("A5_coverage", f"select {COVERAGE} from {WITH_SKILL}")
def _(r):
    return A.coverage(r["jobs"], r["skills"])


@query("A6_coverage_by_source", f"select source_id, {COVERAGE} from {WITH_SKILL} group by source_id")
def _(r):
    return A.coverage(r["jobs"], r["skills"], ["source_id"])


STATES = "select case event_type when 'view' then 'active' when 'click' then 'missing_unconfirmed' when 'error' then 'invalid' when 'signup' then 'inactive' end as lifecycle_status from events"
COLLECTORS = "select distinct l_linestatus as source_id, l_returnflag as collector_version from lineitem"
DESCRIBED = f"select j.*, case when seq % 4 = 0 then ' ' else company_name end as description_clean from ({JOBS}) j"


@query("A5_coverage_report", f"""
with j as ({DESCRIBED}), w as (select j.*, s.job_id is not null as has_skill from j left join (select distinct job_id from ({SKILLS}) x) s on j.job_id = s.job_id), e as ({STATES}),
b as (select source_id, count(*) as n, round(avg(overall_confidence), 4) as c from j group by 1), v as (select source_id, string_agg(collector_version, '/' order by collector_version) as v from ({COLLECTORS}) k group by 1)
select count(*) as total_current_jobs, count(distinct company_name) as unique_companies, count(distinct career_id) as unique_careers, count(distinct province) as unique_provinces, count(*) filter (work_mode = 'REMOTE') as remote_job_count,
       count(*) filter (work_mode <> 'REMOTE' and province is null) as unknown_location_count, count(*) filter (salary_disclosed) as salary_available_count, round(count(*) filter (salary_disclosed) / count(*), 4) as salary_available_rate,
       round(count(*) filter (trim(description_clean) <> '') / count(*), 4) as description_available_rate, round(count(career_id) / count(*), 4) as career_mapping_rate,
       round(count(*) filter (work_mode <> 'REMOTE' and province is not null) / count(*) filter (work_mode <> 'REMOTE'), 4) as location_mapping_rate_non_remote, count(*) filter (has_skill) as jobs_with_mapped_skills,
       round(count(*) filter (has_skill) / count(*), 4) as skill_mapping_rate, count(*) - count(distinct (source_id, source_job_id)) as duplicate_count, round(avg(overall_confidence), 4) as average_extraction_confidence,
       string_agg(distinct snapshot_version, ',' order by snapshot_version) as snapshot_versions, (select count(*) from e) as total_lifecycle_records, (select count(*) from e where lifecycle_status is distinct from 'invalid') as valid_lifecycle_records,
       (select count(*) from e where lifecycle_status = 'invalid') as invalid_records_excluded, (select count(*) from e where lifecycle_status = 'active') as active_jobs, (select count(*) from e where lifecycle_status = 'missing_unconfirmed') as missing_unconfirmed_jobs,
       (select count(*) from e where lifecycle_status = 'inactive') as inactive_jobs, (select string_agg(source_id || '=' || n, ',' order by source_id) from b) as source_distribution, (select round(sum(c), 4) from b) as confidence_by_source,
       (select string_agg(source_id || '=' || v, ',' order by source_id) from v) as collector_versions, '0.4.0' as taxonomy_version from w""")
def _(r):
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], F.array_join(x["value"], "/") if c == "collector_versions" else x["value"].cast("string"))), ",")
    found = A.coverage_report(r.sql(DESCRIBED), r["skills"], r.sql(STATES), r.sql(COLLECTORS), "0.4.0")
    means = F.aggregate(F.map_values("average_extraction_confidence_by_source"), F.lit(0.0), lambda acc, x: acc + x)
    found = found.withColumns({"snapshot_versions": F.array_join("snapshot_versions", ","), "confidence_by_source": F.round(means, 4)})
    return found.withColumns({c: shown(c) for c in ("source_distribution", "collector_versions")}).drop("average_extraction_confidence_by_source")


TAG_SKILLS = "select distinct p_name as tag, p_brand as skill_id, 'Skill ' || p_brand as skill_name, case when p_type <> 'SMALL' then p_type end as category from part where p_type in ('PROMO', 'SMALL')"


@query("A7_tag_frequency", f"""
with t as (select p_name as tag from part), s as ({TAG_SKILLS})
select tag, n, skill_ids, skill_names, skill_categories, skill_ids is not null as is_mapped from (select tag, count(*) as n from t group by tag) c
left join (select tag, string_agg(distinct skill_id, ' | ' order by skill_id) as skill_ids, string_agg(distinct skill_name, ' | ' order by skill_name) as skill_names,
                  string_agg(distinct coalesce(category, 'unspecified'), ' | ' order by coalesce(category, 'unspecified')) as skill_categories from s group by tag) k using (tag)""")
def _(r):
    return A.tag_frequency(r.sql("select p_name as tag from part"), r.sql(TAG_SKILLS))


GAP_JOBS = "select j.*, case when overall_confidence > 0.9 then null else overall_confidence end as career_confidence from ({}) j"


@query("A8_taxonomy_gaps", f"""
with j as ({GAP_JOBS.format(JOBS)}), m as (select job_id, skill_name as tag, requirement_level <> 'not_required' as is_mapped from ({SKILLS}) s)
select job_id, 'career' as gap, null as location_status from j where career_id is null or career_confidence < 0.9
union all select job_id, 'location', case when work_mode = 'REMOTE' then 'remote' else 'unknown' end from j where province is null
union all select distinct job_id, 'skill', null from m where not is_mapped and tag <> ''""")
def _(r):
    tags = r["skills"].select("job_id", F.col("skill_name").alias("tag"), (F.col("requirement_level") != "not_required").alias("is_mapped"))
    return A.taxonomy_gaps(r.sql(GAP_JOBS.format(JOBS)), tags)


@query("A9_simple_matrix", f"""
with s as (select distinct career_id, skill_id, job_id from ({SKILLS}) x)
select career_id, skill_id, count(*) as skill_jobs, career_jobs, round(count(*) / career_jobs, 8) as share from s join (select career_id, count(distinct job_id) as career_jobs from s group by 1) c using (career_id) group by career_id, skill_id, career_jobs""")
def _(r):
    return rounded(A.simple_matrix(r["skills"]))


MAPPING = "select distinct c_mktsegment as career_id, case when c_mktsegment < 'F' then 'G1' else 'G2' end as career_group_id, case when c_mktsegment < 'F' then 'First' else 'Second' end as display_name from customer"
FOUNDATION = "select distinct p_brand as skill_id, 'F_' || p_type as foundation_skill_id from part where p_type in ('PROMO', 'LARGE')"
VERSIONED = f"select j.*, case source_id when 'F' then '0.4.0' else '0.3.9' end as taxonomy_version from ({JOBS}) j"


@query("A10_market_groups", f"""
with m as ({MAPPING}), d as (select * from ({DEMAND}) x join m using (career_id)), k as (select career_id, skill_id from ({MATRIX}) x union select career_id, skill_id from ({SKILLS}) s)
select career_group_id, display_name, n || ' lượt tin trong snapshot; mapping từ ' || ids || '.' as market_signal, n as sample_size, foundation_skill_ids, v || '|map-1' as snapshot_version, taxonomy_version
from (select career_group_id, display_name, cast(sum(posting_count) as bigint) as n, max(snapshot_version) as v, string_agg(distinct career_id, ', ' order by career_id) as ids from d group by 1, 2) a
join (select career_group_id, string_agg(distinct foundation_skill_id, ',' order by foundation_skill_id) as foundation_skill_ids from k join m using (career_id) join ({FOUNDATION}) f using (skill_id) group by 1) b using (career_group_id)
join (select career_group_id, max(taxonomy_version) as taxonomy_version from ({VERSIONED}) j join m using (career_id) group by 1) t using (career_group_id)""")
def _(r):
    skills = kept(r["skills"].drop("job_id"), "skills")  # read by the matrix and beside it
    found = A.market_groups(A.demand_counts(r["jobs"], "seq"), A.skill_matrix(skills), r.sql(VERSIONED), skills, r.sql(MAPPING), r.sql(FOUNDATION), "map-1")
    return found.withColumn("foundation_skill_ids", F.array_join("foundation_skill_ids", ","))


ANSWERS = "select user_id, event_id % 20 as question_id, max(event_type || case when event_id % 2 = 0 then ' ' else '' end) as answer from events group by 1, 2"
QUESTIONS = "select distinct event_id % 4 as career_id, event_id % 20 as question_id, 'Question ' || event_id % 20 as prompt, case event_id % 20 when 3 then null when 4 then ' VIEW' else 'click' end as expected from events"
TAKEN = "select distinct user_id, event_id % 4 as career_id from events"


@query("A11_grade_tests", f"""
with q as (select * from ({QUESTIONS}) x where expected is not null), a as (
  select t.user_id, t.career_id, q.question_id, q.prompt, coalesce(lower(trim(a.answer)), '') = lower(trim(q.expected)) as good
  from ({TAKEN}) t left join q on t.career_id = q.career_id left join ({ANSWERS}) a on a.user_id = t.user_id and a.question_id = q.question_id)
select user_id, career_id, coalesce(round(100 * count(*) filter (good) / nullif(count(question_id), 0), 2), 0) as score, count(*) filter (not good) as wrong,
       coalesce(string_agg(question_id || ':' || prompt, ',' order by question_id) filter (not good), '') as skill_gaps from a group by 1, 2""")
def _(r):
    found = A.grade_tests(r.sql(TAKEN), r.sql(QUESTIONS), r.sql(ANSWERS), ["career_id"], ["user_id"])
    return found.withColumn("skill_gaps", F.array_join(F.transform(F.map_entries("skill_gaps"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"])), ","))


@query("A12_evidence_summary", f"select source_type, count(*) as n from ({EVIDENCE}) e group by 1")
def _(r):
    return A.evidence_summary(r["evidence"])


@query("A13_salary_stats", f"select career_id, median(case when salary_disclosed then salary_mid_vnd end) as salary_median_vnd, count(*) filter (salary_disclosed) as salary_sample_size from ({JOBS}) j group by 1")
def _(r):
    return A.salary_stats(r["jobs"])


# text, hashes, addresses ----------------------------------------------------------------------------------------------

PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("T3_normalize_company", r"select s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name) || ' jsc ltd', '\b(jsc|ltd|limited|cp|cty|tnhh)\b', ' ', 'g'), '\s+', ' ', 'g')) as company from supplier")
def _(r):
    return r.table("supplier").select("s_suppkey", T.normalize_company(F.concat("s_name", F.lit(" JSC  Ltd")), markup=False).alias("company"))


@query("T4_fold_accents", "select doc_id, sha256(strip_accents(lower(text))) as folded from documents")
def _(r):
    return r.table("documents").select("doc_id", F.sha2(T.fold_accents("text").cast("binary"), 256).alias("folded"))


@query("T5_slug", "select doc_id, md5(trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^a-z0-9]+', '_', 'g'), '_')) as slug from documents")
def _(r):
    return r.table("documents").select("doc_id", F.md5(T.slug("text").cast("binary")).alias("slug"))


@query("T6_block_key", r"""select doc_id, md5(trim(regexp_replace(translate(lower(text), '“”‘’–—', '""''''--'), '\s+', ' ', 'g'))) as block_key from documents""")
def _(r):
    return r.table("documents").select("doc_id", F.md5(T.block_key("text").cast("binary")).alias("block_key"))


@query("T7_squeeze", f"select doc_id, md5(nullif({PLAIN}, '')) as squeezed from documents")
def _(r):
    return r.table("documents").select("doc_id", F.md5(T.squeezed_or_null("text").cast("binary")).alias("squeezed"))


@query("T1_clean_text")
def _(r):
    return r.table("pages").select("page_id", T.clean_text("html").alias("text"))


@query("T2_match_text")
def _(r):
    return r.table("pages").select("page_id", T.match_text("html").alias("text"))


@query("T8_extraction_text")
def _(r):
    return r.table("pages").select("page_id", T.extraction_text("html").alias("text"))


@query("T9_clean_title", "select p_partkey, p_name as title from part")
def _(r):
    raw = F.concat(F.lit("[HN] Gấp tuyển 12 bạn "), "p_name", F.lit(" (Lương 10 triệu) - 10 - "), F.col("p_size").cast("string"), F.lit(" triệu gross"))
    return r.table("part").select("p_partkey", T.clean_title(F.replace(raw, F.lit("tuyển 12"), F.lit("tuyển  12")), markup=False).alias("title"))


@query("T10_distinct_lines", r"""
with l as (select doc_id, trim(unnest(string_split(text, chr(10))), ' ') as x, unnest(range(len(string_split(text, chr(10))))) as i from documents),
f as (select doc_id, min_by(x, i) as x, min(i) as i from l where x <> '' group by doc_id, lower(x))
select doc_id, md5(coalesce(string_agg(x, chr(10) order by i), '')) as lines from documents left join f using (doc_id) group by doc_id""")
def _(r):
    return r.table("documents").select("doc_id", F.md5(T.distinct_lines("text").cast("binary")).alias("lines"))


@query("T11_document_metadata", rf"""
with d as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as lines from documents)
select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{T.EMAIL}'))), ',') as emails, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{T.PHONE}'))), ',') as phones,
       len(lines) as line_count, length(text) as character_count, md5(array_to_string(lines[1:20], chr(10))) as preview from d""")
def _(r):
    meta = T.document_metadata("text")
    return r.table("documents").select("doc_id", *(c.alias(k) if k != "preview" else F.md5(c.cast("binary")).alias(k) for k, c in meta.items()))


@query("U1_canonical_url", r"""
with u as (select page_id, regexp_replace(url, '[?#].*$', '') as bare from pages), h as (select page_id, lower(regexp_extract(bare, '^https?://([^/]+)', 1)) as host, regexp_extract(bare, '^https?://[^/]+(/.*)$', 1) as path from u)
select page_id, case when host like '%.example.net' and path not like '%/de/%' and regexp_matches(path, '^/[a-z]+/[0-9]+$') then 'https://' || host || path end as url from h""")
def _(r):
    return r.table("pages").select("page_id", T.canonical_job_url("url", "https://www.example.net", r"\.example\.net$", category="/de/", path=r"^/[a-z]+/[0-9]+$").alias("url"))


@query("U2_id_from_url", r"select page_id, coalesce(nullif(regexp_extract(url, '/(\d+)\.html$', 1), ''), nullif(regexp_extract(url, '-j(\d+)\.html$', 1), ''), sha256(url)[1:16]) as url_id from pages")
def _(r):
    return r.table("pages").select("page_id", T.id_from_url("url").alias("url_id"))


HASH_SQL = rf"sha256(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) || '|' || lower(source) || '|' || lower(lang) || '|' || lower({PLAIN}))"


def _hashed(r: Roles) -> DataFrame:
    return r["posts"].withColumn("content_hash", T.content_hash("title", "source", "lang", "text", markup=False))


@query("H1_content_hash", f"select doc_id, {HASH_SQL} as content_hash from ({POSTS}) p")
def _(r):
    return _hashed(r).select("doc_id", "content_hash")


@query("H2_job_id", f"select doc_id, 'job_' || sha1(source || '|' || case when doc_id % 2 = 0 then cast(doc_id as string) else {HASH_SQL} end)[1:16] as job_id from ({POSTS}) p")
def _(r):
    return _hashed(r).select("doc_id", T.job_id("source", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), F.lit(""), "content_hash").alias("job_id"))


@query("H3_dedup_group_id", f"select doc_id, 'dup_' || {HASH_SQL}[1:16] as dedup_group_id from ({POSTS}) p")
def _(r):
    return _hashed(r).select("doc_id", T.dedup_group_id("content_hash").alias("dedup_group_id"))


@query("H4_cross_source_key", r"select doc_id, case when trim(title) <> '' and doc_id % 5 <> 0 then 'acme|' || lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) || '|' || lower(lang) end as cross_key from (" + POSTS + ") p")
def _(r):
    company = F.when(F.col("doc_id") % 5 != 0, F.lit("Acme JSC"))
    return r["posts"].select("doc_id", T.cross_source_key(company, "title", "lang", markup=False).alias("cross_key"))


@query("H5_stable_id", "select event_id, 'EV_' || sha256('event|' || cast(user_id as string) || '|' || event_type)[1:16] as stable_id from events")
def _(r):
    return r.table("events").select("event_id", T.stable_id("EV", F.lit("event"), "user_id", "event_type").alias("stable_id"))


@query("H6_record_hash", """select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as record_hash from nation""")
def _(r):
    return r.table("nation").select("n_nationkey", T.record_hash(["n_nationkey", "n_name", "n_regionkey"]).alias("record_hash"))


# filters and normalisers ------------------------------------------------------------------------------------------------


@query("F2_parse_tags", """select event_id, case when event_id % 3 = 0 then '' else event_type || ',k' end as tags from events""")
def _(r):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("[broken")).otherwise(F.concat(F.lit('[" '), "event_type", F.lit('", "k", "", "k "]')))
    return r.table("events").select("event_id", F.array_join(J.parse_tags(raw), ",").alias("tags"))


@query("F3_category_page", "select page_id, coalesce(url ilike '%/en/%', false) as hit from pages")
def _(r):
    swapped = F.replace("url", F.lit("/en/"), F.lit("/Danh-muc-"))
    return r.table("pages").select("page_id", L.is_category_page(F.lit("ViecOi"), "viecoi", swapped).alias("hit"))


@query("F4_active_jobs", f"select job_id, source_id from ({JOBS}) j where coalesce(is_active, false) and coalesce(case when seq % 5 = 0 then 'invalid' when seq % 5 = 1 then 'seen' end <> 'invalid', true)")
def _(r):
    jobs = r["jobs"].withColumn("lifecycle_status", F.expr("case when seq % 5 = 0 then 'invalid' when seq % 5 = 1 then 'seen' end"))
    return A.active_jobs(jobs).select("job_id", "source_id")


@query("F5_challenge", "select page_id, regexp_matches(lower(html), 'just a moment|verify you are human|captcha') as challenge from pages")
def _(r):
    return r.table("pages").select("page_id", P.is_challenge("html").alias("challenge"))


PEOPLE = """
select c_custkey, case c_mktsegment when 'BUILDING' then 'STUDENT' when 'FURNITURE' then 'STUDENT' when 'MACHINERY' then 'TEACHER' when 'HOUSEHOLD' then null else 'PROFESSIONAL' end as role,
       case when c_acctbal < 3000 then 'HIGH_SCHOOL' when c_acctbal < 8000 then 'UNIVERSITY' end as stage, case when c_acctbal > 4000 then 'C' || cast(c_nationkey % 3 as string) end as major, 'C' || cast(c_nationkey % 4 as string) as career, 'C' || cast(c_custkey % 3 as string) as target from customer
"""


@query("F7_user_segment", f"""
select c_custkey, case when role = 'STUDENT' and stage = 'HIGH_SCHOOL' then 'HS_FOUNDATION' when role = 'STUDENT' and major = target then 'SV_SAME_MAJOR' when role = 'STUDENT' then 'SV_DIFF_MAJOR'
       when role = 'PROFESSIONAL' and career = target then 'WORKER_SAME_FIELD' when role = 'PROFESSIONAL' then 'WORKER_DIFF_FIELD' else 'HS_FOUNDATION' end as segment from ({PEOPLE}) p""")
def _(r):
    return r.sql(PEOPLE).select("c_custkey", J.user_segment("role", "stage", "major", "career", "target").alias("segment"))


@query("N1_province", """
with d as (select n_name as name, lower(n_name) as alias, n_nationkey as ord from nation), t as (select s_suppkey, 'at ' || n_name || ', floor 2' as loc from supplier join nation on s_nationkey = n_nationkey)
select s_suppkey, min_by(name, ord) as province from t left join d on contains(lower(loc), alias) group by s_suppkey""")
def _(r):
    dim = r.sql("select n_name as name, lower(n_name) as alias, n_nationkey as entity_ord, 0 as alias_ord from nation")
    rows = r.sql("select s_suppkey, 'at ' || n_name || ', floor 2' as loc from supplier join nation on s_nationkey = n_nationkey")
    return N.province(rows, "loc", dim, markup=False).select("s_suppkey", "province")


@query("N2_work_mode", "select o_orderkey, case when o_orderpriority = '1-URGENT' then 'REMOTE' when o_orderpriority = '2-HIGH' then 'HYBRID' when o_orderpriority = '5-LOW' then 'ONSITE' else 'UNSPECIFIED' end as work_mode from orders")
def _(r):
    said = F.when(F.col("o_orderpriority") == "1-URGENT", "Hybrid or Work From Home").when(F.col("o_orderpriority") == "2-HIGH", "on-site, HYBRID").when(F.col("o_orderpriority") == "5-LOW", "Onsite")
    return r.table("orders").select("o_orderkey", N.work_mode(said, "o_orderstatus", F.lit("any"), markup=False).alias("work_mode"))


@query("N3_salary", """
select p_partkey, case p_partkey % 5 when 0 then p_size * 1000000 when 1 then p_size * 1000000 when 3 then p_size * 1000000 end as min_vnd,
       case p_partkey % 5 when 0 then (p_size + 5) * 1000000 when 2 then p_size * 1000000 when 3 then p_size * 1000000 end as max_vnd,
       cast(case p_partkey % 5 when 0 then p_size * 1000000 + 2500000 when 3 then p_size * 1000000 end as double) as mid_vnd, p_partkey % 5 <> 4 as disclosed from part""")
def _(r):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    raw = F.when(k == 0, F.concat(n, F.lit(" - "), (F.col("p_size") + 5).cast("string"), F.lit(" triệu"))).when(k == 1, F.concat(F.lit("Từ "), n, F.lit(" tr"))).when(k == 2, F.concat(F.lit("up to "), n, F.lit(" triệu"))).when(k == 3, F.concat(n, F.lit("M"))).otherwise(F.lit("Thỏa thuận"))
    return r.table("part").select("p_partkey", N.salary(raw, markup=False).alias("s")).select("p_partkey", "s.*")


@query("N4_seniority", "select p_partkey, case when p_partkey % 4 = 0 then 'fresher' when p_partkey % 4 = 1 then 'unknown' when p_size <= 2 then 'junior' when p_size <= 5 then 'mid' else 'senior' end as seniority from part")
def _(r):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "Mới tốt nghiệp, 3 năm").when(k == 1, "any").otherwise(F.concat(F.lit("1 - "), F.col("p_size").cast("string"), F.lit(" năm")))
    return r.table("part").select("p_partkey", N.seniority(raw, markup=False).alias("seniority"))


@query("N5_education", "select p_partkey, case p_partkey % 4 when 0 then 'no_formal_requirement' when 1 then 'vocational_or_above' when 2 then 'university_or_above' else 'unknown' end as education from part")
def _(r):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "Đại học hoặc Trung cấp").when(k == 2, "Đại học").otherwise(F.col("p_name"))
    return r.table("part").select("p_partkey", N.education(raw, markup=False).alias("education"))


@query("N6_posted_date", """
select o_orderkey, case o_orderkey % 5 when 0 then cast(o_orderdate as date) when 1 then cast(o_orderdate as date) - 1 when 2 then cast(o_orderdate as date) - cast(o_orderkey % 30 as int) when 3 then cast(o_orderdate as date) end as posted_at from orders""")
def _(r):
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    raw = F.when(k == 0, "Hôm nay").when(k == 1, "hôm qua").when(k == 2, F.concat((F.col("o_orderkey") % 30).cast("string"), F.lit(" ngày trước"))).when(k == 3, F.concat(F.lit("Đăng "), F.date_format(day, "dd/MM/yyyy")))
    return r.table("orders").select("o_orderkey", N.posted_date(raw, "o_orderdate", markup=False).alias("posted_at"))


@query("N7_experience_years", "select p_partkey, case when p_partkey % 3 < 2 then cast(least(p_size, 7) as double) end as years from part")
def _(r):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("at least "), n, F.lit(" years, or 7+ năm"))).when(k == 1, F.concat(n, F.lit("+ năm and 7 yrs"))).otherwise(F.concat(n, F.lit(" people")))
    return r.table("part").select("p_partkey", N.experience_years(raw, markup=False).alias("years"))


@query("N9_confidence", "select p_partkey, round((p_size / 50.0 + case when p_size > 20 then 1 else 0.4 end + case when p_partkey % 2 = 1 then 1 else 0.3 end + 1) / 4, 3) as confidence from part")
def _(r):
    return r.table("part").select("p_partkey", N.overall_confidence(F.col("p_size") / 50, F.when(F.col("p_size") > 20, "x"), F.col("p_partkey") % 2, "p_name").alias("confidence"))


# pages ------------------------------------------------------------------------------------------------------------------


@query("P1_html_blocks")
def _(r):
    return P.html_blocks(r.table("pages"), "page_id", "html").drop("strong")


LINK = r"""<a\s[^>]*?href\s*=\s*["'']([^"''#]+)["'']"""


@query("P2_extract_links", rf"""
with l as (select distinct page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) as href from pages)
select page_id, href, coalesce(nullif(regexp_extract(href, '/(\d+)\.html$', 1), ''), nullif(regexp_extract(href, '-j(\d+)\.html$', 1), ''), sha256(href)[1:16]) as link_id from l""")
def _(r):
    return P.extract_links(r.table("pages"), "page_id", "html")


@query("P3_parse_listing")
def _(r):
    return P.parse_listing(r.table("pages"), "page_id", "html")


#: Every page as a listing of two cards and a banner: links to a category, to companies and from logos beside those to postings.
LISTING = r"""
select page_id, '<html><body><ul><li><a href="/viec-lam/danh-muc-9.html">All jobs</a></li></ul><section>'
  || '<div class="card"><a class="logo" href="/cong-ty/c-' || page_id || '.html"><img src="x.png"></a><h3><a href="https://viecoi.vn/viec-lam/viec-' || page_id || '.html?utm_source=x">Posting ' || page_id || ' at ' || host || '</a></h3>'
  || '<div><a href="/cong-ty/c-' || page_id || '.html">Cty ' || host || '</a></div><p>' || (5 + length(host)) || ' - ' || (9 + length(host)) || ' triệu</p><p>Hà Nội</p><p>HOT</p><p>12/03/2026</p><p>' || tags || '</p><a href="/viec-lam/viec-' || page_id || '.html#apply">Nộp đơn</a></div>'
  || '<div class="card"><h3><a href="/viec-lam/other-' || (page_id + 1000000) || '.html">Other ' || page_id || '</a></h3><div>Nhóm ' || host || ' (<a href="/cong-ty/all">all</a>)</div><p>Thỏa thuận</p><p>Tây Nguyên</p><p>1/2/2026</p><p>Excel...</p></div></section></body></html>' as html
from (select page_id, split_part(split_part(url, '://', 2), '/', 1) as host, array_to_string(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), ', ') as tags from pages) p
"""


@query("P3_parse_listing_cards", r"""
with p as (select page_id, split_part(split_part(url, '://', 2), '/', 1) as host, array_to_string(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), ', ') as tags from pages),
t as (select *, list_filter(list_transform(string_split(replace(replace(replace(tags, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ','), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) between 2 and 80 and lower(x) not in ('gấp', 'hot', 'mới', 'hà nội')) as ts from p)
select page_id, '/viec-lam/viec-' || page_id || '.html' as href, 'Posting ' || page_id || ' at ' || host as job_title_raw, 'Cty ' || host as company_name_raw, (5 + length(host)) || ' - ' || (9 + length(host)) || ' triệu' as salary_raw, 'Hà Nội' as location_raw, '12/03/2026' as deadline_raw,
       cast(to_json(list_filter(ts, lambda x, i: list_position(list_transform(ts, lambda y: lower(y)), lower(x)) = i)) as varchar) as skills_raw, 14 + cast(contains(tags, ',') as int) as points from t
union all
select page_id, '/viec-lam/other-' || (page_id + 1000000) || '.html', 'Other ' || page_id, 'Nhóm ' || host || ' (', 'Thỏa thuận', 'Tây Nguyên', '1/2/2026', '["Excel..."]', 9 from t""")
def _(r):
    listing = r.table("pages").select(
        "page_id",
        F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"),
        F.array_join(F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a>'), F.lit(1)), ", ").alias("tags"),
    )
    listing.createOrReplaceTempView("listing_parts")
    body = LISTING[: LISTING.index("from (select page_id")] + "from listing_parts"
    found = P.parse_listing(r.spark.sql(body), "page_id", "html", hosts=("viecoi.vn",))
    return found.select("page_id", "href", "job_title_raw", "company_name_raw", "salary_raw", "location_raw", "deadline_raw", "skills_raw", "points")


EMBEDDED = """
select page_id, case when url like '%/en/%' then '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@context":"x","@graph":[{"a":{"b":[{"@type":["Thing","JobPosting"],"title":"Job ' || page_id || '","description":"D"}]}}]}</script>'
                     when url like '%utm_source%' then '<script type="application/ld+json">[{"@type":"Organization"},{"@type":"JobPosting","title":"Top ' || page_id || '"}]</script>' else '' end || html as html from pages
"""


@query("P4_extract_jsonld", rf"""
select page_id, case kind when 1 then '{{"@type":["Thing","JobPosting"],"title":"Job ' || page_id || '","description":"D"}}' when 2 then '{{"@type":"JobPosting","title":"Top ' || page_id || '"}}' end as posting,
       case kind when 1 then 'Job ' || page_id when 2 then 'Top ' || page_id else t end as title, case kind when 1 then 'D' end as description, case when kind > 0 then 'json_ld' when t is not null then 'page_title' else 'none' end as parser_method
from (select page_id, case when url like '%/en/%' then 1 when url like '%utm_source%' then 2 else 0 end as kind, nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)), '') as t from pages) p""")
def _(r):
    return P.extract_jsonld(r.sql(EMBEDDED), "page_id", "html")


@query("P5_typical_tasks")
def _(r):
    task = F.concat(F.lit("<h2>Responsibilities</h2><ul><li>"), F.replace(F.substring_index("html", "<p>", 3), F.lit("<"), F.lit("&lt;")), F.lit("</li></ul>"), "html")
    return P.typical_tasks(P.html_blocks(r.table("pages").withColumn("html", task), "page_id", "html"), "page_id")


LABELLED = "select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id"


@query("P7_missing_rates", f"select count(*) as row_count, count(doc_id) - count(distinct doc_id) as duplicate_ids, round(avg(case when lang is null then 1 else 0 end), 4) as missing_lang, round(avg(case when quality is null then 1 else 0 end), 4) as missing_quality from ({LABELLED}) x")
def _(r):
    return P.missing_rates(r.sql(LABELLED), "doc_id", ["lang", "quality"])


# dictionary matching ------------------------------------------------------------------------------------------------------

ALIASES = ["license", "the", "mit license", "apache license", "queque les", "der", "general public license", "version 2"]
DIM_SQL = "select alias as id, alias as name, alias, entity_ord from (values " + ", ".join(f"('{a}', {k})" for k, a in enumerate(ALIASES)) + ") t(alias, entity_ord)"
BOUND = r"'(^|[^\p{L}\p{N}_])' || alias || '($|[^\p{L}\p{N}_])'"


def named(columns: str, text: str, rows: str) -> str:
    """Rows whose text names an alias, alias by alias, so that DuckDB compiles each pattern once."""
    parts = [rf"select {columns}, '{a}' as skill_id from {rows} where contains({text}, '{a}') and regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_]){a}($|[^\p{{L}}\p{{N}}_])')" for a in ALIASES]
    return " union all ".join(parts)


def _dim(r: Roles) -> DataFrame:
    rows = [(a, a, [a], k) for k, a in enumerate(ALIASES)]
    return M.alias_dim(r.spark.createDataFrame(rows, "id string, name string, aliases array<string>, entity_ord int"))


def _titles(r: Roles) -> DataFrame:
    return r["posts"].select(T.match_text("title", markup=False).alias("title")).distinct()


#: Aliases of two words that begin titles, so that every tier has something to find.
PAIRS = rf"select alias, min(doc_id) as entity_ord from (select split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2) as alias, doc_id from (select doc_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) as t from ({POSTS}) p) x where split_part(t, ' ', 2) <> '') y where length(alias) >= 8 group by alias"
TITLES = rf"(select distinct lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) as title from ({POSTS}) p)"


@query("M1_match_exact", "with d as (select distinct lower(p_name) as alias, p_name as name from part where p_type = 'PROMO') select lower(p_name) as title, min(name) as id, min(name) as name, 1.0 as score from (select distinct p_name from part) p join d on lower(p_name) = alias group by 1")
def _(r):
    dim = r.sql("select p_name as id, p_name as name, lower(p_name) as alias, 0 as entity_ord, 0 as alias_ord from (select distinct p_name from part where p_type = 'PROMO')")
    return M.match_exact(r.sql("select distinct lower(p_name) as title from part"), dim)


@query("M2_match_contained", rf"""
with d as ({PAIRS}), t as (select title, string_split(title, ' ') as w from {TITLES} x),
h as (select distinct t.title, d.alias, d.entity_ord from t, lateral (select unnest(range(1, len(w))) as i) k join d on contains(t.title, d.alias) and d.alias[1:1] is not null where contains(d.alias, w[k.i]) or contains(w[k.i], split_part(d.alias, ' ', 1)))
select title, min_by(alias, (-length(alias), entity_ord)) as id, min_by(alias, (-length(alias), entity_ord)) as name, 0.96 as score
from h where regexp_matches(title, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])' || regexp_escape(alias) || '($|[^\p{{L}}\p{{N}}\p{{M}}_])') group by title""")
def _(r):
    pairs = r["posts"].select("doc_id", F.split(T.match_text("title", markup=False), " ").alias("w")).filter("size(w) > 1 and w[1] <> ''")
    alias = pairs.select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("alias"), "doc_id").filter("length(alias) >= 8").groupBy("alias").agg(F.min("doc_id").alias("entity_ord"))
    return M.match_contained(_titles(r), alias.select(F.col("alias").alias("id"), F.col("alias").alias("name"), "alias", "entity_ord", F.lit(0).alias("alias_ord")))


@query("M3_match_fuzzy")
def _(r):
    dim = r.sql("select distinct p_name as id, p_name as name, p_name as alias, 0 as entity_ord, 0 as alias_ord from part")
    return M.match_fuzzy(r.sql("select distinct p_name || 's' as title from part"), dim)


@query("M4_match_career")
def _(r):
    return M.match_career(r["posts"].select("doc_id", "title"), "title", _dim(r), markup=False)


#: Titles of documents labelled good, and beginnings of the others': copies equal them, others hold them, near copies are like them.
LABELLED_TITLES = f"""
select title as id, title as name, array(title) as aliases, cast(min(doc_id) as int) as entity_ord from ({POSTS}) p where doc_id in (select doc_id from labels where quality = 1) group by title
union all select alias, alias, array(alias), cast(1000000 + min(doc_id) as int) from (select doc_id, split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2) as alias from ({POSTS}) p where doc_id in (select doc_id from labels where quality = 0)) a group by alias
"""


@query("M4_match_career_tiers")
def _(r):
    # titles are first lines: no more of the texts goes into the joins with the labels
    lines = kept(r.table("documents").withColumn("text", F.split_part("text", F.lit("\n"), F.lit(1))), "lines")
    posts = r.sql(POSTS, documents=lines).select("doc_id", "title")
    found = M.match_career(posts, "title", M.alias_dim(r.sql(LABELLED_TITLES, documents=lines)), markup=False)
    return found.select("doc_id", F.md5(F.col("career_id").cast("binary")).alias("career_md5"), "career_confidence")


@query("M5_extract_skills", named("doc_id", "t", "(select doc_id, lower(text) as t from documents) d"))
def _(r):
    return M.extract_skills(r.table("documents"), "doc_id", "text", _dim(r), markup=False).select("doc_id", "skill_id")


@query("M6_sentences", r"select doc_id, count(*) as n, md5(string_agg(trim(x, ' '), '|' order by i)) as joined from (select doc_id, unnest(regexp_split_to_array(text, '[.;\n]')) as x, unnest(range(len(regexp_split_to_array(text, '[.;\n]')))) as i from documents) s where trim(x, ' ') <> '' group by doc_id")
def _(r):
    rows = M.sentences(r.table("documents"), "doc_id", "text")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(ordered, "|").cast("binary")).alias("joined"))


@query("M7_requirement_level", "select event_id, case event_type when 'error' then 'not_required' when 'view' then 'preferred' else 'mentioned' end as level, case event_type when 'error' then 0.98 when 'view' then 0.95 else 0.85 end as confidence from events")
def _(r):
    said = F.when(F.col("event_type") == "error", "sql không bắt buộc, nice to have").when(F.col("event_type") == "view", "sql ưu tiên").otherwise("sql")
    return r.table("events").select("event_id", M.requirement_level(said, "mentioned").alias("l")).select("event_id", "l.*")


@query("M8_skills_from_tags", "with t as materialized (select distinct doc_id, unnest(string_split(lower(text), chr(10))) as tag from documents) select distinct doc_id, skill_id from (" + named("doc_id", "tag", "t") + ") x")
def _(r):
    tags = r.table("documents").withColumn("tags", F.split("text", "\n"))
    return M.extract_skills_from_tags(tags, "doc_id", "tags", _dim(r)).select("doc_id", "skill_id")


@query("M9_process_postings")
def _(r):
    raw = r.sql("""
        select source, source as source_id, cast(doc_id as string) as source_job_id, cast(null as string) as source_url, split_part(text, chr(10), 1) as title_raw, source as company_name_raw, text as description_raw, lang as location_raw,
               cast(null as string) as work_mode_raw, cast(n_chars % 40 as string) || ' triệu' as salary_raw, cast(null as string) as experience_raw, cast(null as string) as education_raw, 'hôm nay' as posted_at_raw, timestamp '2024-01-31 00:00:00' as collected_at from documents""")
    places = r.spark.createDataFrame([("English", "en", 0, 0), ("German", "de", 1, 0)], "name string, alias string, entity_ord int, alias_ord int")
    return J.process_postings(raw, _dim(r), _dim(r), places, "v1", markup=False).drop("skills")


# duplicates and boilerplate -------------------------------------------------------------------------------------------------


@query("D1_duplicate_count", f"select doc_id, count(*) over (partition by content_hash) as duplicate_count from (select doc_id, {HASH_SQL} as content_hash from ({POSTS}) p) h")
def _(r):
    return D.with_duplicate_count(_hashed(r).select("doc_id", "content_hash")).select("doc_id", "duplicate_count")


@query("D2_dedup_identity", f"select job_id, source_id, source_job_id, seq from ({JOBS}) j qualify row_number() over (partition by source_id, source_job_id order by seq desc) = 1")
def _(r):
    return D.dedup_identity(r["jobs"].withColumn("source", F.lit("x")), "seq").select("job_id", "source_id", "source_job_id", "seq")


CROSS = f"select job_id, seq, source_id, career_id || '|' || company_name || '|' || province as cross_source_key from ({JOBS}) j"


@query("D3_group_cross_source", f"""
with c as ({CROSS}), g as (select cross_source_key as k, count(*) as cross_group_size from c where cross_source_key is not null group by 1 having count(distinct source_id) >= 2)
select seq, cross_source_key, 'xsrc_' || sha256(k)[1:16] as cross_group_id, cross_group_size from c left join g on cross_source_key = k""")
def _(r):
    return D.group_cross_source(r.sql(CROSS)).select("seq", "cross_source_key", "cross_group_id", "cross_group_size")


@query("D4_dedup_first", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def _(r):
    return D.dedup_first(r.table("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("D5_dedup_latest", f"select job_id, source_id, source_job_id, collected_at from ({JOBS}) j qualify row_number() over (partition by source_id, source_job_id order by collected_at desc, seq desc) = 1")
def _(r):
    return D.dedup_last(r["jobs"], ["source_id", "source_job_id"], ["collected_at", "seq"]).select("job_id", "source_id", "source_job_id", "collected_at")


BLOCKS = r"""
select * from (select doc_id, source, i as pos, x as block, trim(regexp_replace(translate(lower(x), '“”‘’–—', '""''''--'), '\s+', ' ', 'g')) as key from
  (select doc_id, source, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from documents) l) b where key <> ''
"""
KEYS = f"""
select source, key, n, docs from (select source, key, count(distinct doc_id) as n from ({BLOCKS}) b group by 1, 2) c
join (select source, count(distinct doc_id) as docs from ({BLOCKS}) b group by 1) d using (source) where docs >= 3 and n >= ceil(docs * 0.05)
"""
SPLIT = f"""
select doc_id, source, coalesce(string_agg(block, chr(10) order by pos) filter (not common), '') as role_text, coalesce(string_agg(block, chr(10) order by pos) filter (common), '') as boilerplate_text,
       count(*) as block_count, count(*) filter (common) as boilerplate_count, round(avg(cast(common as int)), 4) as boilerplate_ratio
from (select b.*, k.key is not null as common from ({BLOCKS}) b left join ({KEYS}) k on b.source = k.source and b.key = k.key) x group by 1, 2
"""


def _boilerplate(r: Roles) -> tuple[DataFrame, DataFrame]:
    blocks = D.text_blocks(r.table("documents"), "doc_id", "source", "text")
    return blocks, D.boilerplate_keys(blocks, "doc_id", "source", 0.05)


@query("B1_boilerplate_keys", KEYS)
def _(r):
    return _boilerplate(r)[1]


@query("B2_split_boilerplate", f"select * replace (md5(role_text) as role_text, md5(boilerplate_text) as boilerplate_text) from ({SPLIT}) s")
def _(r):
    split = D.split_boilerplate(r.table("documents"), _boilerplate(r)[1], "doc_id", "source", "text")
    return split.withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("role_text", "boilerplate_text")})


@query("B3_boilerplate_stats", f"select source, count(*) as docs, round(avg(boilerplate_ratio), 4) as mean_ratio, max(boilerplate_ratio) as max_ratio, cast(sum(length(role_text) + length(boilerplate_text)) as bigint) as chars_before, cast(sum(length(role_text)) as bigint) as chars_after from ({SPLIT}) s group by 1")
def _(r):
    return D.boilerplate_stats(D.split_boilerplate(r.table("documents"), _boilerplate(r)[1], "doc_id", "source", "text"), "source").drop("length_quartiles")


# lifecycle --------------------------------------------------------------------------------------------------------------------

#: Runs of equal length that the whole of ``events`` is dealt into.
WHOLE_RUNS = 6


def _all_runs(r: Roles, invalid: bool = False) -> DataFrame:
    """The state after one merge for each of ``WHOLE_RUNS`` equal ranges of time from the first event to the last."""
    events = r.table("events").withColumn("_at", F.col("ts").cast("timestamp")).withColumn("_s", F.unix_micros("_at"))
    low, high = events.agg(F.min("_s"), F.max("_s")).first()
    low, high = low or 0, high or 0
    step = (high - low) // WHOLE_RUNS + 1
    dealt = events.withColumn("_run", F.floor((F.col("_s") - low) / step)).groupBy("_run", F.col("user_id").cast("string").alias("source_job_id"))
    crawls = dealt.agg(F.lit("e").alias("source_id"), F.max_by("event_type", "event_id").alias("content_hash"), F.max("_at").alias("collected_at"))
    state = L.empty_state(r.spark)
    for n in range(WHOLE_RUNS):
        at, crawl = F.timestamp_micros(F.lit(low + (n + 1) * step - 1)), crawls.filter(F.col("_run") == n).drop("_run")
        if invalid:
            good, bad = L.mark_invalid(crawl, F.col("source_job_id").cast("int") % 3 == 0, at)
            state = L.with_invalid(L.lifecycle_merge(good, state, at), bad)
        else:
            state = L.lifecycle_merge(crawl, state, at)
    return state


#: Every key's runs, and the last state that they lead to.
LIFECYCLE = f"""
with b as (select epoch_us(min(ts)) as lo, (epoch_us(max(ts)) - epoch_us(min(ts))) // {WHOLE_RUNS} + 1 as step from events),
k as (select cast(user_id as string) as source_job_id, (epoch_us(ts) - lo) // step as run, max_by(event_type, event_id) as h from events, b group by 1, 2),
w as (select *, lag(run) over (partition by source_job_id order by run) as before, lag(h) over (partition by source_job_id order by run) as h_before from k),
s as (select source_job_id, max(run) as run, max_by(h, run) as h, max_by(before, run) as before, max_by(h_before, run) as h_before, count(*) as runs from w group by 1)
select source_job_id, h as content_hash, cast({WHOLE_RUNS} - 1 - run as int) as consecutive_missing_runs, {WHOLE_RUNS} - 1 - run < 3 as is_active, runs > 1 and run = {WHOLE_RUNS} - 1 and h <> h_before as content_changed,
       case when runs > 1 and h <> h_before then h_before end as previous_content_hash, case when run = {WHOLE_RUNS} - 1 and runs = 1 then 'new' when run = {WHOLE_RUNS} - 1 then 'seen' when {WHOLE_RUNS} - 1 - run >= 3 then 'inactive' else 'missing_unconfirmed' end as lifecycle_status,
       runs > 1 and run = {WHOLE_RUNS} - 1 and run - before > 3 as reactivated from s
"""


@query("L3_lifecycle_merge", LIFECYCLE)
def _(r):
    return _all_runs(r).select("source_job_id", "content_hash", "consecutive_missing_runs", "is_active", "content_changed", "previous_content_hash", "lifecycle_status", "reactivated")


@query("L4_mark_invalid", f"select source_job_id, case when cast(source_job_id as int) % 3 = 0 then 'invalid' else lifecycle_status end as lifecycle_status, cast(source_job_id as int) % 3 <> 0 and is_active as is_active from ({LIFECYCLE}) x")
def _(r):
    return _all_runs(r, invalid=True).select("source_job_id", "lifecycle_status", "is_active")


@query("L5_status_counts", f"select lifecycle_status, count(*) as n from ({LIFECYCLE}) x group by 1")
def _(r):
    return A.status_counts(_all_runs(r))


@query("L3_lifecycle_merge_whole")
def _(r):
    return _all_runs(r).select("source_job_id", "content_hash", "consecutive_missing_runs", "is_active", "content_changed", "previous_content_hash", "lifecycle_status", "reactivated", "inactive_at")


@query("L4_mark_invalid_whole")
def _(r):
    return _all_runs(r, invalid=True).select("source_job_id", "lifecycle_status", "is_active")


@query("L5_status_counts_whole")
def _(r):
    return A.status_counts(_all_runs(r))


RUNS = "select user_id, cast(ts as date) as day, max_by(event_type, event_id) as h from events group by 1, 2"


@query("L6_lifecycle_replay", f"""
with s as ({RUNS}), r as (select day, row_number() over (order by day) as n from (select distinct day from s) d), k as (select user_id as key, n as run_no, h from s join r using (day)),
g as (select key, r.n as run_no from (select key, min(run_no) as f from k group by 1) x join r on r.n >= f),
j as (select g.key, g.run_no, k.h is not null as seen, k.h, max(k.run_no) over w as last_seen from g left join k on g.key = k.key and g.run_no = k.run_no window w as (partition by g.key order by g.run_no)),
p as (select key, run_no, lag(run_no) over (partition by key order by run_no) as before, lag(h) over (partition by key order by run_no) as h_before from k)
select j.key, j.run_no, j.run_no - last_seen as missing_runs, case when seen and before is null then 'new' when seen then 'seen' when j.run_no - last_seen >= 3 then 'inactive' else 'missing_unconfirmed' end as status,
       coalesce(seen and h <> h_before, false) as content_changed, coalesce(seen and j.run_no - before > 3, false) as reactivated from j left join p on j.key = p.key and j.run_no = p.run_no""")
def _(r):
    return L.lifecycle_replay(r.sql(RUNS), "user_id", "day", "h").withColumn("run_no", F.col("run_no").cast("long")).withColumn("missing_runs", F.col("missing_runs").cast("long"))


# learners -------------------------------------------------------------------------------------------------------------------------

WEIGHT = "case source_type when 'assessment' then 1.0 when 'academic_record' then 0.9 when 'teacher_observation' then 0.8 when 'activity_result' then 0.7 else 0.4 end"


def ability_sql(evidence: str) -> str:
    return f"""
select student_id, skill_id, round(vw / w, 6) as estimated_level, round(least(1.0, greatest(0.0, least(1.0, w / 2) * case when n = 1 and a = 'self_report' then 0.6 when n > 1 and a = b then 0.85 else 1.0 end
       * case when spread > 0.35 then greatest(0.25, 1 - (spread - 0.35) / 0.65) else 1.0 end)), 6) as confidence, n as evidence_count, spread from (
  select student_id, skill_id, sum(normalized_value * {WEIGHT}::double * confidence) as vw, sum({WEIGHT}::double * confidence) as w, count(*) as n, min(source_type) as a, max(source_type) as b, max(normalized_value) - min(normalized_value) as spread
  from ({evidence}) e where skill_id not like 'INTEREST\\_%' escape '\\' group by 1, 2) s"""


ABILITY = ability_sql(EVIDENCE)
LIMITS = [("SKILL_0", 0.65, 1.0, "ACT0", 20), ("SKILL_1", 0.5, 0.8, "ACT1", 50), ("SKILL_2", 0.3, 1.0, None, None)]
LIMITS_SQL = "(values " + ", ".join(f"('{s}', {x}, {i}, {'null' if a is None else repr(a)}, {'null' if m is None else m})" for s, x, i, a, m in LIMITS) + ") t(skill_id, expected_level, importance, activity_id, activity_minutes)"
GAPS = f"""
select student_id, 'GAP_' || sha256('academic|' || skill_id)[1:16] as gap_id, skill_id, estimated_level, expected_level, gap_size, score,
       case when score >= 0.25 and confidence >= 0.55 then 'high' when score >= 0.1 then 'medium' else 'low' end as priority from (
  select *, round(gap_size * confidence * importance * case when exam_week then 1.4 else 1.2 end * case when coalesce(activity_minutes <= weekly_available_minutes, false) then 1.0 else 0.75 end, 6) as score from (
    select a.*, expected_level::double as expected_level, importance::double as importance, activity_minutes, weekly_available_minutes, exam_week, round(expected_level::double - estimated_level, 6) as gap_size from ({ABILITY}) a join {LIMITS_SQL} using (skill_id) join ({STUDENTS}) s using (student_id) where estimated_level < expected_level) x) y
"""
GROUP_ACTS = [("G0", "ACT0", 20), ("G1", "ACT1", 25), ("G2", "ACT2", 45)]
ACTS_SQL = "(values " + ", ".join(f"('{g}', '{a}', {m})" for g, a, m in GROUP_ACTS) + ") t(career_group_id, activity_id, estimated_minutes)"
INTERESTS = f"select student_id, weekly_available_minutes, exam_week, unnest([0, 1]) as pos, unnest(['G' || (cast(student_id as int) % 4), 'G' || ((cast(student_id as int) + 1) % 4)]) as career_group_id from ({STUDENTS}) s"
EXPLORED = f"select distinct student_id, career_group_id from ({RESULTS}) r where completed and rubric_score / max_score >= 0.6"
EXPLORATION = f"""
select student_id, career_group_id, pos, activity_id, case when estimated_minutes <= weekly_available_minutes then 'high' else 'medium' end as priority
from ({INTERESTS}) i left join {ACTS_SQL} using (career_group_id) where not exists (select 1 from ({EXPLORED}) e where e.student_id = i.student_id and e.career_group_id = i.career_group_id)
"""


DONE = f"select distinct student_id, activity_id from ({RESULTS}) r where completed and rubric_score >= 0.9 * max_score"


def _limits(r: Roles) -> DataFrame:
    return r.spark.createDataFrame(LIMITS, "skill_id string, expected_level double, importance double, activity_id string, activity_minutes int")


def _acts(r: Roles) -> DataFrame:
    return r.spark.createDataFrame(GROUP_ACTS, "career_group_id string, activity_id string, estimated_minutes int")


def _students(r: Roles) -> DataFrame:
    n = F.col("student_id").cast("int")
    group = lambda k: F.concat(F.lit("G"), ((n + k) % 4).cast("string"))
    return r["students"].withColumn("career_interest_ids", F.array(group(0), group(1)))


def _gaps(r: Roles) -> DataFrame:
    return E.academic_gaps(E.ability_profile(r["evidence"]), r["students"], _limits(r))


def _exploration(r: Roles) -> DataFrame:
    return E.exploration_gaps(_students(r), r["results"], _acts(r))


@query("E1_evidence_academic", "select cast(l_suppkey as string) as student_id, 'EV_' || sha256('academic_record|' || l_orderkey || '|' || l_returnflag)[1:16] as evidence_id, 'academic_record' as source_type, l_returnflag as skill_id, l_quantity / 50 as normalized_value, 1.0 as confidence from lineitem")
def _(r):
    rows = r.sql("select cast(l_orderkey as string) as record_id, cast(l_suppkey as string) as student_id, l_returnflag as topic_id, l_quantity as score, 50D as max_score, l_shipdate as observed_at from lineitem")
    return E.evidence_academic(rows).drop("observed_at")


@query("E2_evidence_observation", "select cast(user_id as string) as student_id, event_id % 7 as k, case event_type when 'view' then 0.65 when 'click' then 0.5 when 'error' then 0.1 end as normalized_value, value / 500 as confidence from events")
def _(r):
    kind = F.when(F.col("event_type") == "view", "strength").when(F.col("event_type") == "click", "neutral").when(F.col("event_type") == "error", "weakness")
    severity = F.when(F.col("event_type") == "error", "high").otherwise("low")
    rows = r.table("events").select(F.col("event_id").alias("observation_id"), F.col("user_id").cast("string").alias("student_id"), (F.col("event_id") % 7).cast("string").alias("skill_id"), kind.alias("observation_type"), severity.alias("severity"), (F.col("value") / 500).alias("confidence"), F.col("ts").alias("observed_at"))
    return E.evidence_observation(rows).select("student_id", F.col("skill_id").cast("long").alias("k"), "normalized_value", "confidence")


@query("E3_evidence_assessment", "select cast(o_custkey as string) as student_id, p as skill_id, v as normalized_value from (select o_custkey, unnest(['a', 'b']) as p, unnest([o_totalprice / 1000000, o_orderkey / 1000000]) as v from orders) x")
def _(r):
    score = lambda name, c: F.struct(F.lit(name).alias("skill_id"), F.col(c).cast("double").alias("score"), F.lit(1000000.0).alias("max_score"))
    rows = r.table("orders").select(F.col("o_custkey").cast("string").alias("student_id"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("completed_at"), F.array(score("a", "o_totalprice"), score("b", "o_orderkey")).alias("skill_scores"))
    return E.evidence_assessment(rows).select("student_id", "skill_id", "normalized_value")


@query("E5_evidence_activity", f"select student_id, 'S' || career_group_id as skill_id, rubric_score / max_score as normalized_value from ({RESULTS}) r where completed and career_group_id <> 'G3'")
def _(r):
    catalog = r.spark.createDataFrame([("ACT0", "SG0"), ("ACT1", "SG1"), ("ACT2", "SG2"), ("ACT3", None)], "activity_id string, rubric_skill_id string")
    return E.evidence_activity(r["results"].withColumn("completed_at", F.lit("2024-01-01").cast("timestamp")), catalog).select("student_id", "skill_id", "normalized_value")


@query("E6_merge_evidence", f"select * exclude (observed_at) from ({EVIDENCE}) e")
def _(r):
    e = r["evidence"]
    return E.merge_evidence(e.filter("normalized_value < 0.2"), e).drop("observed_at")


@query("E7_ability_profile", f"select * exclude (spread) from ({ABILITY}) a")
def _(r):
    return E.ability_profile(r["evidence"])


TREND_OLD = "select * from ({}) e where cast(observed_at as date) <= date '2024-01-10'"


@query("E8_ability_trend", f"with c as ({ABILITY}), p as ({ability_sql(TREND_OLD.format(EVIDENCE))}) select c.student_id, c.skill_id, c.estimated_level, case when p.estimated_level is null then 'unknown' when c.estimated_level - p.estimated_level >= 0.05 then 'improving' when c.estimated_level - p.estimated_level <= -0.05 then 'declining' else 'stable' end as trend from c left join p using (student_id, skill_id)")
def _(r):
    return E.ability_trend(E.ability_profile(r["evidence"]), E.ability_profile(r.sql(TREND_OLD.format(EVIDENCE)))).select("student_id", "skill_id", "estimated_level", "trend")


@query("E9_academic_gaps", GAPS)
def _(r):
    return _gaps(r)


@query("E11_exploration_gaps", EXPLORATION)
def _(r):
    return _exploration(r)


@query("E12_decision_gaps", f"select student_id, count(*) as interests, count(e.student_id) as explored from (select student_id, i.career_group_id, e.student_id from ({INTERESTS}) i left join ({EXPLORED}) e using (student_id, career_group_id)) x group by 1 having count(*) >= 2 and count(e.student_id) < count(*)".replace("count(e.student_id)", "count(found)").replace("i.career_group_id, e.student_id from", "career_group_id, found from").replace(f"({EXPLORED}) e", f"(select *, 1 as found from ({EXPLORED}) z) e"))
def _(r):
    return E.decision_gaps(_students(r), r["results"])


@query("E13_weekly_plan", f"""
with done as ({DONE}), a as (
  select g.student_id, first(l.activity_id order by gap_size desc, gap_id) as activity_id, first(activity_minutes order by gap_size desc, gap_id) as minutes
  from ({GAPS}) g join {LIMITS_SQL.replace(') t(', ') l(')} using (skill_id) join ({STUDENTS}) b on b.student_id = g.student_id where priority = 'high' and activity_minutes <= weekly_available_minutes
  and not exists (select 1 from done where done.student_id = g.student_id and done.activity_id = l.activity_id) group by g.student_id),
i as (select student_id, first(activity_id order by pos) as activity_id from ({EXPLORATION}) x where activity_id is not null and not exists (select 1 from done where done.student_id = x.student_id and done.activity_id = x.activity_id) group by 1)
select student_id, 1 as task_no, activity_id, minutes from a
union all select s.student_id, 2, i.activity_id, estimated_minutes from ({STUDENTS}) s join i using (student_id) join {ACTS_SQL} on t.activity_id = i.activity_id left join a on a.student_id = s.student_id
where not exam_week and estimated_minutes <= weekly_available_minutes - coalesce(a.minutes, 0)""")
def _(r):
    return E.weekly_plan(r["students"], _gaps(r), _exploration(r), _limits(r), _acts(r), r.sql(DONE))


ASOF = {k: f"select user_id, event_type, ts as at, event_id as attempt_id, value from events where event_type = '{k}'" for k in ("view", "purchase")}
ASOF_SQL = f"""
select user_id, posttest_id, after, baseline_id, before from (
  select p.user_id, p.attempt_id as posttest_id, p.value as after, b.attempt_id as baseline_id, b.value as before, row_number() over (partition by p.attempt_id order by b.at desc, b.attempt_id desc) as k
  from ({ASOF['purchase']}) p join ({ASOF['view']}) b on p.user_id = b.user_id and b.at <= p.at) x where k = 1
"""
STATUS = "case when delta <= -0.05 then 'regression' when delta < 0.05 then 'no_meaningful_change' when delta < 0.2 then 'partial_improvement' else 'meaningful_improvement' end"


def _asof(r: Roles) -> DataFrame:
    return E.asof_baseline(r.sql(ASOF["purchase"]), r.sql(ASOF["view"]), ["user_id"])


@query("E14_assessment_outcomes", f"select pair_id, student_id, 'S' as skill_id, before, after, delta, {STATUS} as status from (select posttest_id as pair_id, user_id as student_id, before / 500 as before, after / 500 as after, round(after / 500 - before / 500, 10) as delta from ({ASOF_SQL}) a) d")
def _(r):
    pairs = _asof(r).select(F.col("posttest_id").alias("pair_id"), F.col("user_id").alias("student_id"), F.lit("S").alias("skill_id"), (F.col("before") / 500).alias("b"), (F.col("after") / 500).alias("a"))
    return E.assessment_outcomes(pairs.withColumn("value", F.col("b")), pairs.withColumn("value", F.col("a")))


@query("E15_asof_baseline", ASOF_SQL)
def _(r):
    return _asof(r).select("user_id", "posttest_id", "after", "baseline_id", "before")


@query("E16_interest_outcomes", f"select student_id, activity_result_id, career_group_id, before, after, delta, {STATUS} as status from (select *, interest_before / interest_max_score as before, interest_after / interest_max_score as after, round(interest_after / interest_max_score - interest_before / interest_max_score, 10) as delta from ({RESULTS}) r where completed) d")
def _(r):
    return E.interest_outcomes(r["results"])


@query("E17_next_step", f"""
with done as ({DONE}), a as (select student_id, 1 as tier, -gap_size as k, gap_id as tie, l.activity_id from ({GAPS}) g join {LIMITS_SQL.replace(') t(', ') l(')} using (skill_id) where priority = 'high' and l.activity_id is not null),
b as (select student_id, 2 as tier, cast(pos as double) as k, '' as tie, activity_id from ({EXPLORATION}) x where activity_id is not null),
m as (select student_id, first(tier order by tier, k, tie) as tier, first(activity_id order by tier, k, tie) as activity_id from (select * from a union all select * from b) u
      where not exists (select 1 from done where done.student_id = u.student_id and done.activity_id = u.activity_id) group by 1)
select student_id, case tier when 1 then 'academic' when 2 then 'exploration' else 'none' end as step, activity_id from ({STUDENTS}) s left join m using (student_id)""")
def _(r):
    return E.next_step(r["students"], _gaps(r), _exploration(r), _limits(r), r.sql(DONE))


WARNED = f"""
select student_id, 'insufficient_evidence' as code, 'ability_profile.' || skill_id as field from ({ABILITY}) a where evidence_count < 2
union all select student_id, 'conflicting_evidence', 'ability_profile.' || skill_id from ({ABILITY}) a where spread > 0.35 union all select student_id, 'low_confidence_estimate', 'ability_profile.' || skill_id from ({ABILITY}) a where confidence < 0.55
"""


@query("E18_evidence_warnings", WARNED)
def _(r):
    return E.evidence_warnings(r["evidence"])


MARKET = [("G0", 9), ("G1", 4), ("G3", 20)]
MARKET_SQL = "(values " + ", ".join(f"('{g}', {n})" for g, n in MARKET) + ") m(career_group_id, sample_size)"
REPORTS = "select cast(user_id as string) as student_id from events where event_type = 'purchase'"


@query("E19_initial_warnings", f"""
select student_id, 'optional_data_missing' as code, 'self_report' as field from ({STUDENTS}) s where student_id not in ({REPORTS})
union all select s.student_id, 'insufficient_evidence', 'ability_profile' from ({STUDENTS}) s left join (select student_id, count(*) as n from ({EVIDENCE}) e group by 1) e using (student_id) where coalesce(n, 0) < 2
union all {WARNED}
union all select student_id, 'unknown_career_group', 'student.career_interest_ids.' || pos from ({INTERESTS}) i where career_group_id not in (select career_group_id from {MARKET_SQL} join {ACTS_SQL} using (career_group_id))
union all select student_id, 'small_market_sample', 'market_context' from ({STUDENTS}) s""")
def _(r):
    market = r.spark.createDataFrame(MARKET, "career_group_id string, sample_size int")
    return E.initial_warnings(_students(r), {"self_report": r.sql(REPORTS)}, r["evidence"], _acts(r), market)


TRIES = {k: f"select user_id, event_type, ts as at, event_id as attempt_id, value from events where event_type = '{k}'" for k in ("signup", "purchase")}
TRY_SKILLS = "select event_id as attempt_id, 'S' || event_id % 3 as skill_id from events union all select event_id, 'S' || (event_id + 1) % 3 from events where value > 100"
VERSIONS = "select cast(user_id as string) as student_id, case when min(event_id) % 3 = 0 then '1' else '2' end as current_version, case when max(event_id) % 5 > 0 then '2' end as expected_version from events group by user_id"
PAIRED = f"""
select p.user_id, p.attempt_id, p.idx, b.attempt_id as baseline_id from (select *, row_number() over (partition by x.user_id order by x.at, x.attempt_id) - 1 as idx from ({TRIES['purchase']}) x) p
left join ({TRIES['signup']}) b on p.user_id = b.user_id and b.at <= p.at qualify row_number() over (partition by p.attempt_id order by b.at desc nulls last, b.attempt_id desc) = 1
"""


@query("E20_followup_warnings", f"""
with p as ({PAIRED}), k as ({TRY_SKILLS})
select cast(user_id as string) as student_id, 'baseline_not_found' as code, 'assessment_attempts.posttest.' || idx as field from p where baseline_id is null
union all select cast(user_id as string), 'assessment_scale_mismatch', 'assessment_attempts.posttest.' || idx || '.skill_scores' from p where baseline_id is not null and not exists (select 1 from k x join k y on x.skill_id = y.skill_id where x.attempt_id = p.attempt_id and y.attempt_id = p.baseline_id)
union all select student_id, 'stale_profile_version', 'student.schema_version' from ({VERSIONS}) v where current_version <> expected_version""")
def _(r):
    posts = r.sql(f"select cast(user_id as string) as student_id, attempt_id, row_number() over (partition by x.user_id order by x.at, x.attempt_id) - 1 as idx from ({TRIES['purchase']}) x")
    paired = E.asof_baseline(r.sql(TRIES["purchase"]), r.sql(TRIES["signup"]), ["user_id"])
    return E.followup_warnings(posts, paired, r.sql(TRY_SKILLS), r.sql(VERSIONS))


@query("E21_overlay_profile", f"with c as ({ABILITY}), p as ({ability_sql(TREND_OLD.format(EVIDENCE))}) select student_id, skill_id, coalesce(c.estimated_level, p.estimated_level) as estimated_level, case when skill_id = 'SKILL_1' then 'declining' when c.skill_id is not null then 'stable' else 'unknown' end as trend from p full join c using (student_id, skill_id)")
def _(r):
    now = E.ability_profile(r["evidence"]).withColumn("trend", F.lit("stable"))
    old = E.ability_profile(r.sql(TREND_OLD.format(EVIDENCE))).withColumn("trend", F.lit("unknown"))
    return E.overlay_profile(old, now, now.filter("skill_id = 'SKILL_1'").select("student_id", "skill_id", F.lit("regression").alias("status")))


@query("E22_snapshot")
def _(r):
    first = E.snapshot(E.ability_profile(r.sql(TREND_OLD.format(EVIDENCE))), r.spark.createDataFrame([], "student_id string, snapshot_id string"), "v1")
    return E.snapshot(E.ability_profile(r["evidence"]), first.select("student_id", "snapshot_id"), "v1").select("student_id", "snapshot_id", "previous_snapshot_id", F.size("abilities").alias("skills"))


# profiles -------------------------------------------------------------------------------------------------------------------------


@query("C3_interest_profile", """
with m as (select c_mktsegment as career_id, case c_nationkey % 6 when 0 then 'Realistic' when 1 then 'Investigative' when 2 then 'Artistic' when 3 then 'Social' when 4 then 'Enterprising' else 'Conventional' end as e, c_nationkey % 6 as ord, avg(round(c_acctbal)) as s from customer group by 1, 2, 3),
k as (select *, row_number() over (partition by career_id order by s desc, ord) as n from m) select career_id, string_agg(e[1], '' order by n) as interest_code from k where n <= 3 group by 1""")
def _(r):
    names = F.array(*map(F.lit, C.DIMENSIONS))
    rows = r.table("customer").select(F.col("c_mktsegment").alias("career_id"), F.get(names, F.col("c_nationkey") % 6).alias("element_name"), F.round("c_acctbal").alias("data_value"))
    return C.interest_profile(rows)


@query("C4_rated_skills", "select n_name as onetsoc_code, cast(s_suppkey % 3 as string) as element_id, 'e' as element_name, max(case when s_suppkey % 2 = 0 then s_acctbal end) as importance, max(case when s_suppkey % 2 = 1 then s_acctbal end) as level from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 5 <> 0 group by 1, 2")
def _(r):
    rows = r.sql("select n_name as onetsoc_code, cast(s_suppkey % 3 as string) as element_id, 'e' as element_name, case when s_suppkey % 2 = 0 then 'IM' else 'LV' end as scale_id, s_acctbal as data_value, case when s_suppkey % 5 = 0 then 'Y' end as recommend_suppress, 'N' as not_relevant from supplier join nation on s_nationkey = n_nationkey")
    return C.rated_skills(rows)


TOP = f"select career_id, skill_id, skill_name, postings, rank from (select career_id, skill_id, skill_name, max(skill_posting_count) as postings, row_number() over (partition by career_id order by max(skill_posting_count) desc, skill_id, skill_name) as rank from ({MATRIX}) m group by 1, 2, 3) t where rank <= 10"


@query("C6_top_market_skills", TOP)
def _(r):
    return C.top_market_skills(A.skill_matrix(r["skills"]))


@query("C10_market_breakdown", f"""
select career_id, string_agg(coalesce(province, '-') || '/' || work_mode || '/' || posting_count, ',' order by k) filter (k <= 20) as rows, string_agg(distinct province, ',' order by province) as provinces, string_agg(distinct work_mode, ',' order by work_mode) as work_modes
from (select *, row_number() over (partition by career_id order by posting_count desc, province nulls last, work_mode) as k from ({DEMAND}) d) x group by 1""")
def _(r):
    found = C.market_breakdown(A.demand_summary(r["jobs"], "seq"))
    shown = F.transform("rows", lambda x: F.concat_ws("/", F.coalesce(x["province"], F.lit("-")), x["work_mode"], x["posting_count"].cast("string")))
    return found.select("career_id", F.array_join(shown, ",").alias("rows"), F.array_join("provinces", ",").alias("provinces"), F.array_join("work_modes", ",").alias("work_modes"))


@query("C12_changed_rows", "select c_custkey from customer where c_custkey % 3 = 0")
def _(r):
    now = r.table("customer")
    old = now.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, -1.0).otherwise(F.col("c_acctbal")))
    cache = old.withColumn("record_hash", T.record_hash(now.columns)).select("c_custkey", "record_hash")
    return C.changed_rows(now, cache, "c_custkey")[0].select("c_custkey")


PROFILES = "select cast(c_custkey as string) as profile_id, 'Brand#' || cast((c_custkey + k) % 25 + 1 as string) as skill_id from customer, (select 0 as k union all select 7 union all select 11) x"


@query("R1_rank_careers", f"select profile_id, career_id, matched, row_number() over (partition by profile_id order by matched desc, career_id) as rank from (select profile_id, career_id, count(distinct skill_id) as matched from ({PROFILES}) p join (select distinct career_id, skill_id from ({MATRIX}) m where skill_posting_count > 3) m using (skill_id) group by 1, 2) x")
def _(r):
    return C.rank_careers(r.sql(PROFILES), A.skill_matrix(r["skills"]).filter("skill_posting_count > 3"))


@query("R1_best_career", f"select profile_id, arg_min(career_id, (-matched, career_id)) as career_id, max(matched) as matched from (select profile_id, career_id, count(distinct skill_id) as matched from ({PROFILES}) p join (select distinct career_id, skill_id from ({MATRIX}) m) m using (skill_id) group by 1, 2) x group by 1")
def _(r):
    return C.best_career(r.sql(PROFILES), A.skill_matrix(r["skills"]))


# lookups --------------------------------------------------------------------------------------------------------------------------


@query("Q1_upsert_catalog", "select c_custkey, c_name, case when c_custkey % 2 = 0 then 'new' else c_mktsegment end as c_mktsegment from customer")
def _(r):
    now = r.table("customer").select("c_custkey", "c_name", "c_mktsegment")
    return Q.upsert_catalog(now, now.filter("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("new")), "c_custkey")


@query("Q2_search_catalog", "select p_partkey, p_name, total from (select p_partkey, p_name || ' ' || p_partkey as p_name, count(*) over () as total from part where contains(lower(p_name), 'red')) x order by p_name limit 20")
def _(r):
    part = r.table("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("p_name"))
    return Q.search_catalog(part, "p_name", "p_name", "RÉD", 20)


@query("Q3_career_detail", "select n_nationkey, n_name, coalesce(string_agg(s_name, ',' order by s_name), '') as aliases from nation left join supplier on s_nationkey = n_nationkey group by 1, 2")
def _(r):
    aliases = r.table("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return Q.career_detail(r.table("nation").select("n_nationkey", "n_name"), aliases, "n_nationkey", "s_name").withColumn("aliases", F.array_join("aliases", ","))


@query("Q4_recent_sources", "select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey) as rank from orders) x where rank <= 10")
def _(r):
    return Q.recent_per_key(r.table("orders"), ["o_custkey"], "o_orderdate", "o_orderkey", 10).select("o_custkey", "o_orderkey", "rank")


@query("Q5_match_results", "select o_orderkey, o_custkey % 40 as career_id, n_name as career_name from orders left join nation on o_custkey % 40 = n_nationkey")
def _(r):
    rows = r.table("orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("career_id"))
    return Q.match_results(rows, r.table("nation").select(F.col("n_nationkey").cast("long").alias("career_id"), F.col("n_name").alias("career_name")))


@query("Q6_roster", "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and c_custkey % 3 = s_suppkey % 3")
def _(r):
    left = r.table("customer").select("c_custkey", F.col("c_nationkey").alias("tenant"), (F.col("c_custkey") % 3).alias("class"))
    return Q.roster(left, r.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("tenant"), (F.col("s_suppkey") % 3).alias("class")), ["tenant", "class"]).select("c_custkey", "s_suppkey")


@query("Q7_interval_join", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem join orders on l_orderkey = o_orderkey where o_orderdate <= l_shipdate and (o_orderstatus = 'O' or o_orderdate + interval 60 day >= l_shipdate)")
def _(r):
    spans = r.sql("select o_orderkey as k, o_orderdate as starts_at, case when o_orderstatus <> 'O' then o_orderdate + interval 60 days end as ends_at from orders")
    points = r.table("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return Q.interval_join(points, spans, ["k"], "l_shipdate", "starts_at", "ends_at").select(F.col("k").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")


@query("Q8_latest_status", "select c_custkey, coalesce(status, 'not_started') as status from customer left join (select o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders group by 1) o on c_custkey = o_custkey")
def _(r):
    orders = r.table("orders").withColumnRenamed("o_custkey", "c_custkey")
    return Q.latest_status(r.table("customer"), orders, "c_custkey", "o_orderdate", "o_orderkey", "o_orderstatus").select("c_custkey", "status")


@query("Q9_history", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rank from orders")
def _(r):
    return Q.recent_per_key(r.table("orders"), ["o_custkey"], "o_orderdate", "o_orderkey", 2**31 - 1).select("o_custkey", "o_orderkey", "rank")


DRAFTS = {"state": "select distinct user_id as draft_id, event_id % 9 as question_id, 'old' as answer from events", "changes": "select user_id as draft_id, event_id % 12 as question_id, max(case when event_id % 5 = 0 then '' else event_type end) as answer, cast(user_id % 2 as int) as expected_version from events where event_type = 'click' group by 1, 2, 4"}


@query("Q10_merge_drafts", f"""
with s as ({DRAFTS['state']}), c as ({DRAFTS['changes']})
select draft_id, question_id, case when c.expected_version is not null then c.answer else s.answer end as answer from s full join (select * from c where expected_version = 1) c using (draft_id, question_id) where case when c.expected_version is not null then c.answer else s.answer end <> ''""")
def _(r):
    versions = r.sql("select distinct user_id as draft_id, 1 as version from events")
    return Q.merge_drafts(r.sql(DRAFTS["state"]), r.sql(DRAFTS["changes"]), versions)


@query("Q11_student_snapshot", "select c_custkey, o.n as n_orders, o.first_order from customer left join (select o_custkey, count(*) as n, min_by(o_orderkey, (o_orderdate, o_orderkey)) as first_order from orders group by 1) o on c_custkey = o_custkey")
def _(r):
    orders = r.table("orders").withColumnRenamed("o_custkey", "c_custkey")
    found = Q.student_snapshot(r.table("customer").select("c_custkey"), "c_custkey", {"orders": (orders, ["o_orderdate", "o_orderkey", "o_orderstatus"])})
    n = F.when(F.col("orders").isNotNull(), F.size("orders")).cast("long")
    return found.select("c_custkey", n.alias("n_orders"), F.get("orders", F.lit(0))["o_orderkey"].alias("first_order"))


@query("Q12_cascade_delete", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def _(r):
    ids = r.table("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    items = r.table("lineitem").withColumnRenamed("l_orderkey", "k")
    return Q.cascade_delete(r.table("orders").withColumnRenamed("o_orderkey", "k"), items, ids, "k")[1].select(F.col("k").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("Q13_sample_balanced")
def _(r):
    return Q.sample_balanced(r.table("documents"), "lang", "doc_id", 10, 42).select("lang", "doc_id", "rank")


# checks ---------------------------------------------------------------------------------------------------------------------------


@query("V2_unique", "select 'unique:l_orderkey,l_linenumber' as rule, l_orderkey || '|' || l_linenumber as key, cast(count(*) as varchar) as detail from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def _(r):
    return V.unique(r.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("V3_not_blank", f"select 'not_blank:quality' as rule, cast(doc_id as varchar) as key, 'null or blank' as detail from ({LABELLED}) x where quality is null")
def _(r):
    return V.not_blank(r.sql(LABELLED), "quality", "doc_id")


@query("V4_ranges", """
select 'range:c_acctbal' as rule, cast(c_custkey as varchar) as key, cast(c_acctbal as varchar) as detail from customer where c_acctbal < 0 or c_acctbal > 9000
union all select 'domain:c_mktsegment', cast(c_custkey as varchar), c_mktsegment from customer where c_mktsegment not in ('BUILDING', 'HOUSEHOLD')""")
def _(r):
    c = r.table("customer")
    return V.in_range(c, "c_acctbal", "c_custkey", 0.0, 9000.0).unionByName(V.in_domain(c, "c_mktsegment", "c_custkey", ["BUILDING", "HOUSEHOLD"]))


@query("V5_references", "select 'references:doc_id' as rule, cast(doc_id as varchar) as key, cast(doc_id as varchar) as detail from documents where doc_id not in (select doc_id from labels)")
def _(r):
    return V.references(r.table("documents").withColumn("k", F.col("doc_id")), "doc_id", "k", r.table("labels"), "doc_id")


@query("V6_reconciled", f"select 'reconciled:demand' as rule, concat_ws('|', career_id, career_name, province, work_mode, snapshot_version) as key, (salary_sample_size + 1) || '/' || salary_sample_size as detail from ({DEMAND}) d where work_mode = 'REMOTE'")
def _(r):
    jobs = r["jobs"]
    off = A.demand_summary(jobs, "seq").withColumn("salary_sample_size", F.col("salary_sample_size") + F.when(F.col("work_mode") == "REMOTE", 1).otherwise(0))
    return V.reconciled(jobs, off, seq_col="seq")


#: Whole documents, with a sentence by language and one by source, so that every rule meets texts that break it.
SAID = """
select doc_id, text || case lang when 'de' then ' See skill_TRIG-1.' when 'fr' then ' Em KÉM lắm' when 'es' then ' your Gap Priority' else '' end || case source when 'src1' then ' and 9,5 Điểm' when 'src2' then ' MY_SKILL_X' else '' end as text from documents
"""
SAID_LOWER = " or ".join("contains(lower(text), '{}')".format(w) for w in V.UNSAFE), " or ".join("contains(lower(text), '{}')".format(w) for w in V.ENGINE_FIELDS)


@query("V13_text_policy", rf"""
with d as ({SAID})
select 'text_policy' as rule, cast(doc_id as varchar) as key, 'technical_id' as detail from d where regexp_matches(text, '(?i)\b(EVIDENCE|SKILL|CAREER_GROUP)_[A-Za-z0-9_-]+\b')
union all select 'text_policy', cast(doc_id as varchar), 'unsafe' from d where {SAID_LOWER[0]}
union all select 'text_policy', cast(doc_id as varchar), 'engine_field' from d where {SAID_LOWER[1]}
union all select 'text_policy', cast(doc_id as varchar), 'score_promise' from d where regexp_matches(text, '(?i)\b\d+([.,]\d+)?\s*điểm\b')""")
def _(r):
    return V.text_policy(r.sql(SAID), F.col("doc_id"), "text")


@query("V15_plan_invariant", f"select 'delta' as rule, activity_result_id as key, '0.0' as detail from ({RESULTS}) r where completed and interest_after > 0.000001")
def _(r):
    return V.delta_invariant(E.interest_outcomes(r["results"]).withColumn("delta", F.lit(0.0)), "activity_result_id")


@query("V16_production_metrics", f"""
select count(*) as job_count, count(distinct source_id) as source_count, count(career_id) as mapped_careers, count(*) filter (salary_disclosed) as salary_disclosed, count(*) filter (work_mode = 'REMOTE') as remote, count(*) - count(distinct job_id) as duplicate_ids,
       (select count(*) from ({SKILLS}) s) as skill_rows, (select count(distinct job_id) from ({SKILLS}) s) as jobs_with_skill from ({JOBS}) j""")
def _(r):
    return V.production_metrics(r["jobs"], r["skills"])


@query("V12_report_reconciled")
def _(r):
    report = A.coverage(r["jobs"], r["skills"], ["source_id"]).withColumn("location_rate", F.col("location_rate") + 1)
    return V.report_reconciled(report, "job_count", ["job_count"], ["career_rate", "location_rate"], "source_id")


# more of profiles, learners, sources ------------------------------------------------------------------------------------------

CODES = "select distinct c_mktsegment as career_id, n_name as onetsoc_code from customer join nation on c_nationkey = n_nationkey"
TEXTS = f"select j.*, company_name as description_raw from ({JOBS}) j"
EVIDENCE_TEXTS = f"""
select career_id, 'posting' as source_type, job_id as reference_id, description_raw as text from ({TEXTS}) j where is_active and career_id is not null and trim(description_raw) <> ''
union all select career_id, 'occupation', onetsoc_code, concat_ws(chr(10), 'about ' || onetsoc_code, tasks) from ({CODES}) c
left join (select n_name, string_agg(s_name, chr(10) order by cast(s_suppkey as string)) as tasks from supplier join nation on s_nationkey = n_nationkey group by 1) t on n_name = onetsoc_code
"""


def _evidence_texts(r: Roles) -> DataFrame:
    occupations = r.sql("select n_name as onetsoc_code, n_name as title, 'about ' || n_name as description from nation")
    tasks = r.sql("select n_name as onetsoc_code, cast(s_suppkey as string) as task_id, s_name as task, 'Core' as task_type from supplier join nation on s_nationkey = n_nationkey")
    return C.career_evidence(r.sql(TEXTS), occupations, tasks, r.sql(CODES))


@query("C1_career_evidence", EVIDENCE_TEXTS)
def _(r):
    return _evidence_texts(r)


@query("C2_career_facts", f"""
select career_id, 'market_skill' as fact_type, skill_id as name, round(skill_posting_count / posting_count, 8) as value, skill_posting_count as sample_size from (
  select m.*, d.posting_count from ({MATRIX}) m left join ({DEMAND}) d on m.career_id is not distinct from d.career_id and m.province is not distinct from d.province and m.work_mode is not distinct from d.work_mode) x
union all select c_mktsegment, 'interest', cast(c_nationkey % 6 as string), round(avg(c_nationkey), 3), count(*) from customer group by c_mktsegment, c_nationkey % 6""")
def _(r):
    share = A.skill_share(A.skill_matrix(r["skills"]), A.demand_summary(r["jobs"], "seq"))
    interests = r.sql("select c_mktsegment as career_id, cast(c_nationkey % 6 as string) as element_name, cast(c_nationkey as double) as data_value from customer")
    return rounded(C.career_facts(share, interests))


@query("C5_software_skills", "select p_brand as onetsoc_code, p_name as name, p_size > 25 as in_demand, p_type = 'PROMO' as hot from part")
def _(r):
    return C.software_skills(r.sql("select p_brand as onetsoc_code, p_name as workplace_example, case when p_size > 25 then 'Y' else 'N' end as in_demand, case when p_type = 'PROMO' then 'Y' end as hot_technology from part"))


SOFT = "select p_brand as career_id, p_name as name, p_size > 40 as in_demand, p_type = 'PROMO' as hot from part"
RATED = "select p_brand as career_id, p_type as element_name, max(p_retailprice) as importance from part group by 1, 2"


@query("C7_top_skills_with_fallback", f"""
with k as (select career_id, lower(name) as k, min(struct_pack(a := case when in_demand then 0 else 1 end, b := case name when 'red widget' then 1 when 'small ring' then 2 else 1000 end, c := case when hot then 0 else 1 end, name := name)) as o from ({SOFT}) s where (in_demand or hot) and career_id > 'Brand#2' group by 1, 2),
s as (select career_id, o.name as name, 1 as tier, cast(row_number() over (partition by career_id order by o) as double) as key from k), t as (select * from s where key <= 6 union all select career_id, element_name, 2, -importance from ({RATED}) r where career_id > 'Brand#2'),
f as (select career_id, name, row_number() over (partition by career_id order by tier, key, name) as rank, case when tier = 1 then 'software' else 'rated' end as origin from t)
select * from f where rank <= 10 union all select distinct p_brand, 'Known', 1, 'market' from part where p_brand <= 'Brand#2'""")
def _(r):
    market = r.sql("select distinct p_brand as career_id, 'Known' as skill_name, 1 as rank from part where p_brand <= 'Brand#2'")
    return C.top_skills_with_fallback(market, r.sql(SOFT), r.sql(RATED), ["red widget", "small ring"])


@query("C8_career_tasks", """
with t as (select c_mktsegment as career_id, 0 as tier, c_custkey as ord, 'Call ' || c_nationkey as task from customer where c_custkey % 2 = 0 union all select c_mktsegment, case when c_custkey % 3 = 0 then 1 else 2 end, c_custkey, 'call: ' || c_nationkey % 30 from customer),
k as (select career_id, min(struct_pack(tier := tier, ord := ord, task := task)) as m from t group by career_id, trim(regexp_replace(lower(task), '[^\\p{L}\\p{N}_]+', ' ', 'g')))
select career_id, row_number() over (partition by career_id order by m) as rank, m.task as task, case when m.tier = 0 then 'posting' else 'occupation' end as origin from k qualify rank <= 10""")
def _(r):
    a = r.sql("select c_mktsegment as career_id, c_custkey as ord, 'Call ' || c_nationkey as task from customer where c_custkey % 2 = 0")
    b = r.sql("select c_mktsegment as career_id, c_custkey as task_id, 'call: ' || c_nationkey % 30 as task, case when c_custkey % 3 = 0 then 'Core' else 'Other' end as task_type from customer")
    return C.career_tasks(a, b)


@query("C9_overlay_translation", "select c_mktsegment as career_id, c_custkey as rank, c_name as task, case when c_custkey % 2 = 0 then 'vi ' || c_name else c_name end as text_vi from customer")
def _(r):
    tasks = r.sql("select c_mktsegment as career_id, c_custkey as rank, c_name as task from customer")
    return C.overlay_translation(tasks, tasks.filter("rank % 2 = 0").withColumn("text_vi", F.concat(F.lit("vi "), "task")))


@query("C11_career_profiles", f"""
with c as (select distinct c_mktsegment as career_id from customer union all select 'NONE'),
e as (select career_id, count(*) filter (source_type = 'posting') as postings, count(*) filter (source_type = 'occupation') as refs, min_by(text, (case when source_type = 'occupation' then 0 else 1 end, reference_id)) as overview from ({EVIDENCE_TEXTS}) x group by 1),
m as (select career_id, cast(sum(posting_count) as bigint) as n from ({DEMAND}) d group by 1)
select career_id, career_id as career_name, coalesce(postings, 0) as postings, coalesce(refs, 0) as "references", coalesce(n, 0) as market_postings, overview,
       case when postings > 0 or refs > 0 then 'available' else 'insufficient_evidence' end as status, 'v1' as profile_version from c left join e using (career_id) left join m using (career_id)""")
def _(r):
    careers = r.sql("select distinct c_mktsegment as career_id, c_mktsegment as career_name from customer union all select 'NONE', 'NONE'")
    return C.career_profiles(careers, _evidence_texts(r), A.demand_summary(r["jobs"], "seq"), "v1")


@query("E4_evidence_self_report", "select cast(c_custkey as string) as student_id, 'INTEREST_' || g as skill_id, v as normalized_value from (select c_custkey, unnest(['A', 'B']) as g, unnest([c_nationkey / 25.0::double, c_custkey % 10 / 10.0::double]) as v from customer) x")
def _(r):
    item = lambda g, v: F.struct(F.lit(g).alias("career_group_id"), v.cast("double").alias("interest_score"))
    scores = F.array(item("A", F.col("c_nationkey") / 25), item("B", F.col("c_custkey") % 10 / 10))
    rows = r.table("customer").select(F.col("c_custkey").cast("string").alias("student_id"), F.col("c_custkey").alias("report_id"), F.lit("2024-01-01").cast("timestamp").alias("observed_at"), F.transform(scores, lambda s: F.struct(s["career_group_id"].alias("career_group_id"), s["interest_score"].alias("interest_score"), F.lit(1.0).alias("max_score"))).alias("career_interests"))
    return E.evidence_self_report(rows).select("student_id", "skill_id", "normalized_value")


@query("E10_priority_score", "select l_orderkey, l_linenumber, l_partkey, round(l_discount * (l_quantity / 50) * 0.8::double * case when l_returnflag = 'R' then 1.4::double else 1.2::double end * case when l_linestatus = 'O' then 1.0::double else 0.75::double end, 6) as score from lineitem")
def _(r):
    score = E.priority_score(F.col("l_discount"), F.col("l_quantity") / 50, F.lit(0.8), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return r.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


@query("E23_map_interests", "select c_custkey, case when c_mktsegment = 'BUILDING' then 'G_DATA,G_BUILD' when c_mktsegment = 'MACHINERY' then 'G_DATA' else 'G_NONE' end as groups from customer")
def _(r):
    tokens = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("Data mining"), "c_mktsegment", F.lit("big DATA"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("data")))
    groups = E.map_interests(tokens, {"data": "G_DATA", "build": "G_BUILD"}, "G_NONE")
    return r.table("customer").select("c_custkey", F.array_join(groups, ",").alias("groups"))


@query("F6_display_if", """
with a as (select user_id as submission_id, 'q' || cast(event_id % 3 as string) as question_id, max(event_type) as value from events group by 1, 2), w as (select distinct submission_id from a),
h as (select w.submission_id, coalesce(q1.value = 'view', false) as eq, coalesce(q1.value <> 'view' and q1.value <> '', false) as ne, coalesce(q2.value in ('view', 'signup'), false) as isin from w left join a q1 on q1.submission_id = w.submission_id and q1.question_id = 'q1' left join a q2 on q2.submission_id = w.submission_id and q2.question_id = 'q2')
select submission_id, 'x' as question_id, eq and isin as is_visible from h union all select submission_id, 'y', ne from h""")
def _(r):
    answers = r.sql("select user_id as submission_id, 'q' || cast(event_id % 3 as string) as question_id, max(event_type) as value from events group by 1, 2")
    rows = [("x", "q1", "equals", "view"), ("x", "q2", "in", "view|signup"), ("y", "q1", "not_equals", "view")]
    return V.visible(r.spark.createDataFrame(rows, "question_id string, depends_on string, operator string, operand string"), answers)


@query("V7_one_version", "select distinct 'one_version:v' as rule, 'orders' as key, o_orderstatus as detail from orders union all select distinct 'one_version:v', 'lineitem', l_linestatus from lineitem")
def _(r):
    return V.one_version({"orders": r.sql("select o_orderstatus as v from orders"), "lineitem": r.sql("select l_linestatus as v from lineitem")}, "v")


@query("S7_split_jobs_skills", "select cast(o_orderkey as string) as job_id, o_orderpriority as work_mode, l_partkey as skill_id, l_quantity as level from orders join lineitem on o_orderkey = l_orderkey")
def _(r):
    nested = r.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("skill_id"), F.col("l_quantity").alias("level"))).alias("skills"))
    jobs = r.table("orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderpriority").alias("work_mode"), "o_totalprice", "skills")
    return split_jobs_skills(jobs)[1]


@query("S10_jsonify_complex", """select user_id, '{"first":' || min(event_id) || ',"last":' || max(event_id) || '}' as span from events group by user_id""")
def _(r):
    return jsonify_complex(r.table("events").groupBy("user_id").agg(F.struct(F.min("event_id").alias("first"), F.max("event_id").alias("last")).alias("span")))


@query("S1_read_snapshot", "select doc_id, lang, source from documents")
def _(r):
    return read_snapshot(r.spark, f"{r.sf_dir}/documents.parquet", ["doc_id", "lang", "source"]).select("doc_id", "lang", "source")


@query("S6_career_code_map", "select distinct c_mktsegment as career_id, 'N' || c_nationkey as onetsoc_code from customer")
def _(r):
    return career_code_map(r.sql("select c_mktsegment as career_id, array_agg('N' || c_nationkey) as codes from customer group by c_mktsegment, c_acctbal > 0"))


@query("L1_prepare_keys", "select event_id, event_type as source_id, cast(user_id as string) as source_job_id from events")
def _(r):
    return L.prepare_keys(r.sql("select event_id, '  ' || event_type || ' ' as source_id, user_id as source_job_id from events"))


@query("L2_observed_at", "select strftime(max(ts), '%Y-%m-%d %H:%M:%S') as observed_at from events")
def _(r):
    return L.observed_at(r.sql("select ts as collected_at from events")).select(F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"))


@query("P6_extract_documents", "select doc_id, case when lang = 'de' or trim(text) = '' then 'failed' else 'completed' end as status, case when lang = 'de' then 'unsupported type' when trim(text) = '' then 'empty document' end as error, case when lang <> 'de' and trim(text) <> '' then length(text) end as character_count from documents")
def _(r):
    files = r.sql("select doc_id, cast(text as binary) as content, case lang when 'de' then 'a.pdf' else 'a.TXT' end as name from documents")
    return P.extract_documents(files, "doc_id", "content", "name").select("doc_id", "status", "error", "character_count")


from marketloom.plans import landing, questionnaires  # noqa: E402, F401  they register their queries too
