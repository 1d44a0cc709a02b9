"""Registered queries of scans, sinks, published versions and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import normalize as N
from marketloom.operators import aggregate as A
from marketloom.operators import learner as E
from marketloom.operators import matching as M
from marketloom.operators import postings as J
from marketloom.operators import profiles as C
from marketloom.plans.demo import Roles, role_sql
from marketloom.plans.registry import DEMAND, GAPS, LIFECYCLE, LIMITS, MATRIX, PROFILES, WHOLE_RUNS, query
from marketloom.sources import tables as S
from marketloom.sources.versions import Conflict, EmptySnapshot, Warehouse, kept, work_dir
from marketloom.streaming.lifecycle import lifecycle_view, sightings_stream

JOBS, SKILLS = role_sql("jobs"), role_sql("skills")


# the lifecycle as a stream --------------------------------------------------------------------------------------------


@query("L7_lifecycle_stream", LIFECYCLE)
def _(r: Roles) -> DataFrame:
    """All events as files of a stream, some in each batch, in whatever order they are read; then the state after the last."""
    events = r.table("events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("at"))
    low, high = events.agg(F.min("us"), F.max("us")).first()
    step = ((high or 0) - (low or 0)) // WHOLE_RUNS + 1
    landed, root, checkpoint = (work_dir(r.spark, f"crawls-{part}") for part in ("landed", "state", "checkpoint"))
    crawl = F.floor((F.col("us") - F.lit(low or 0)) / step).cast("long")
    rows = events.select(F.lit("e").alias("source_id"), F.col("user_id").cast("string").alias("source_job_id"), crawl.alias("crawl"), F.col("event_id").alias("seq"), F.col("event_type").alias("content_hash"), F.col("at").alias("collected_at"))
    rows.repartition(8, "source_job_id").write.parquet(landed)
    stream = r.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(landed)
    running = sightings_stream(stream, root, checkpoint)
    running.awaitTermination()
    last = running.lastProgress
    # a batch that the log has, but that had no rows, has no state of its own
    batch = max(p["batchId"] for p in running.recentProgress if p["numInputRows"]) if last else 0
    return lifecycle_view(r.spark, root, batch).select("source_job_id", "content_hash", "consecutive_missing_runs", "is_active", "content_changed", "previous_content_hash", "lifecycle_status", "reactivated")


# published versions -----------------------------------------------------------------------------------------------------


def _warehouse(r: Roles) -> Warehouse:
    """Three versions: all postings; then two publishers that both start from the first, of which one has to start again."""
    house = Warehouse(r.spark, work_dir(r.spark, "warehouse"))
    # skills are made from the postings as written, later versions from what the first one holds: the source tables are joined
    # once; the skills are the same in all versions
    house.publish({"jobs_clean": r["jobs"], "job_skills": lambda written: r.skills_of(written["jobs_clean"])}, 0)
    jobs = house.table("jobs_clean", 1)
    house.publish({"jobs_clean": jobs.filter("is_active")}, 1, filled=["jobs_clean"], same=["job_skills"])
    try:
        house.publish({"jobs_clean": jobs.limit(0)}, 1)
    except Conflict:
        house.update(lambda latest: {"jobs_clean": house.table("jobs_clean", latest).filter("province is not null")}, same=["job_skills"])
    return house


@query("S9_publish_versions", f"""
select version, dataset, row_count, case when dataset = 'jobs_clean' then 'v1' else '' end as snapshot_versions from (
  select 1 as version, 'jobs_clean' as dataset, count(*) as row_count from ({JOBS}) j union all select 2, 'jobs_clean', count(*) from ({JOBS}) j where is_active
  union all select 3, 'jobs_clean', count(*) from ({JOBS}) j where is_active and province is not null union all select v, 'job_skills', count(*) from ({SKILLS}) s, (select unnest([1, 2, 3]) as v) x group by v) t""")
def _(r: Roles) -> DataFrame:
    house = _warehouse(r)
    every = [house.manifest(n) for n in range(1, house.latest() + 1)]
    both = every[0]
    for m in every[1:]:
        both = both.unionByName(m)
    return both.select("version", "dataset", "row_count", F.array_join("snapshot_versions", ",").alias("snapshot_versions"))


@query("S11_read_versions", f"""
select 2 as version, source_id, count(*) as n, round(sum(salary_mid_vnd), 4) as pay from ({JOBS}) j where is_active group by source_id
union all select 3, source_id, count(*), round(sum(salary_mid_vnd), 4) from ({JOBS}) j where is_active and province is not null group by source_id""")
def _(r: Roles) -> DataFrame:
    house = _warehouse(r)
    sums = lambda v: house.table("jobs_clean", v).groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("salary_mid_vnd"), 4).alias("pay")).select(F.lit(v or house.latest()).alias("version"), "source_id", "n", "pay")
    return sums(2).unionByName(sums(None))


@query("S12_empty_snapshot_guard", f"select 3 as version, count(*) as row_count, 2 as refused from ({JOBS}) j where is_active and province is not null")
def _(r: Roles) -> DataFrame:
    """Neither an empty snapshot nor one that starts from an old version takes the latest one's place."""
    house, refused = _warehouse(r), 0
    nothing = house.table("jobs_clean", 1).filter("salary_mid_vnd < 0")
    for based_on, error in ((house.latest(), EmptySnapshot), (1, Conflict)):
        try:
            house.publish({"jobs_clean": nothing}, based_on, filled=["jobs_clean"])
        except error:
            refused += 1
    return house.table("jobs_clean").agg(F.count("*").alias("row_count")).select(F.lit(house.latest()).alias("version"), "row_count", F.lit(refused).alias("refused"))


# landing scans -----------------------------------------------------------------------------------------------------------

#: Documents as lines of raw postings: those of over 4,000 characters are cut short, those of one source have no title.
POSTED = "select doc_id, source, n_chars, 'd' || cast(doc_id as string) as source_job_id, case when source <> 'src1' then lang end as title_raw from documents"


@query("S2_landing_scan", f"""
with p as ({POSTED})
select 'good' as kind, source as what, count(*) as n, sum(length(source_job_id)) as size from p where n_chars <= 4000 and title_raw is not null group by 2
union all select 'bad', 'missing: title_raw', count(*), null from p where n_chars <= 4000 and title_raw is null having count(*) > 0
union all select 'bad', 'not JSON of this schema', count(*), null from p where n_chars > 4000 having count(*) > 0""")
def _(r: Roles) -> DataFrame:
    path = work_dir(r.spark, "postings")
    line = F.to_json(F.struct("source", "source_job_id", "title_raw", F.lit("x").alias("not_in_the_schema")))
    shown = F.when(F.col("n_chars") > 4000, F.substring(line, 1, 25)).when(F.col("source") == "src0", F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    r.sql(POSTED).select(shown).write.text(path)
    good, bad = S.land_raw_postings(r.spark, path)
    counted = good.groupBy(F.lit("good").alias("kind"), F.col("source").alias("what")).agg(F.count("*").alias("n"), F.sum(F.length("source_job_id")).alias("size"))
    return counted.unionByName(bad.groupBy(F.lit("bad").alias("kind"), F.col("reason").alias("what")).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("size")))


@query("S3_flatten_board", """
with j as (select c_nationkey, c_custkey, c_name, c_mktsegment, row_number() over (partition by c_nationkey, c_custkey // 2 order by c_custkey) as k from customer)
select cast(c_nationkey as varchar) as source_id, cast(c_custkey // 2 as varchar) as source_job_id, c_name as title_raw, case when c_custkey % 2 = 0 then 'City ' || c_nationkey else 'Town ' || c_custkey end as location_raw, c_mktsegment || ' | Open' as industry_raw
from j where k = 1""")
def _(r: Roles) -> DataFrame:
    """A board for each nation, its customers two by two under one id; places as objects or texts."""
    parts = r.sql("""
        select c_nationkey, c_custkey, to_json(named_struct('id', c_custkey div 2, 'title', c_name, 'departments', array(named_struct('name', ' ' || c_mktsegment, 'deep', array(named_struct('name', 'no'))), named_struct('name', 'Open', 'deep', null)))) as job,
               case when c_custkey % 2 = 0 then '"location":{"name":"City ' || cast(c_nationkey as string) || '","in":{"name":"no"}}' else '"location":"Town ' || cast(c_custkey as string) || '"' end as place from customer""")
    whole = parts.select("c_nationkey", "c_custkey", F.concat(F.expr("substring(job, 1, length(job) - 1)"), F.lit(","), "place", F.lit("}")).alias("j"))
    boards = whole.groupBy(F.col("c_nationkey").cast("string").alias("source_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "j"))), lambda x: x["j"]), ",").alias("jobs"))
    payload = boards.select("source_id", F.lit("2026-01-01").alias("fetched_at"), F.concat(F.lit('{"jobs":['), "jobs", F.lit("]}")).alias("payload"))
    broken = payload.withColumns({"payload": F.substring("payload", 1, 60), "fetched_at": F.lit("2025-12-31")})
    return S.flatten_board_payload(payload.unionByName(broken), "payload").select("source_id", "source_job_id", "title_raw", "location_raw", "industry_raw")


@query("S4_reference_rows", """
select 'good' as kind, n_name as what, count(*) as n from supplier join nation on s_nationkey = n_nationkey where s_acctbal >= 0 group by 2
union all select 'bad', 'missing: onetsoc_code', count(*) from supplier where s_acctbal < 0 having count(*) > 0""")
def _(r: Roles) -> DataFrame:
    path = work_dir(r.spark, "reference")
    rows = r.sql("select s_nationkey, case when s_acctbal >= 0 then n_name end as onetsoc_code, cast(s_suppkey as string) as task_id, s_name as task, 'Core' as task_type from supplier join nation on s_nationkey = n_nationkey")
    rows.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(F.struct("onetsoc_code", "task_id", "task", "task_type")).alias("row"))).alias("j")).select("j").repartition(8).write.option("lineSep", "\n").text(path)
    lines, _ = S.landing(r.spark, path, "row array<struct<onetsoc_code: string, task_id: string, task: string, task_type: string>>", ["row"])
    lines.withColumn("n", F.monotonically_increasing_id()).select("n", F.to_json(F.struct("row")).alias("j")).write.partitionBy("n").text(path + "-files")
    good, bad = S.land_reference_rows(r.spark, path + "-files/*", "task")
    return good.groupBy(F.lit("good").alias("kind"), F.col("onetsoc_code").alias("what")).agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.lit("bad").alias("kind"), F.col("reason").alias("what")).agg(F.count("*").alias("n")))


@query("N8_embedded_posting", """
select c_custkey, case when c_custkey % 7 = 0 then null when c_custkey % 3 = 0 then null else 'VND' end as currency, case when c_custkey % 7 = 0 or c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then round(c_acctbal) else 5 end as salary_min,
       case when c_custkey % 7 = 0 or c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then round(c_acctbal) + 9 else 5 end as salary_max, case when c_custkey % 7 = 0 or c_custkey % 3 = 0 then null else 'MONTH' end as salary_unit,
       case when c_custkey % 7 = 0 then null when c_custkey % 4 = 0 then c_name || ', N' || c_nationkey when c_custkey % 4 = 1 then c_name || ' | N' || c_nationkey || ', VN' when c_custkey % 4 = 2 then c_mktsegment end as location from customer""")
def _(r: Roles) -> DataFrame:
    """Customers as postings: places as an object, a list with repeats, a text, or none; pay as a range, a value or a text; some broken."""
    text = """case when c_custkey % 7 = 0 then '{"jobLocation":{"address":' else '{"@type":"JobPosting","jobLocation":' ||
        case c_custkey % 4 when 0 then '{"address":{"streetAddress":"' || c_name || '","addressRegion":{"@type":"R","name":"N' || cast(c_nationkey as string) || '"},"addressCountry":""}}'
             when 1 then '[{"address":"' || c_name || '"},{"address":{"addressLocality":"N' || cast(c_nationkey as string) || '","addressCountry":{"a":{"b":1},"name":"VN"}}},{"address":"' || c_name || '"},7,{"address":[1]}]'
             when 2 then '{"address":"' || c_mktsegment || '"}' else 'null' end || ',"baseSalary":' ||
        case c_custkey % 3 when 0 then '"negotiable"' when 1 then '{"currency":"VND","value":{"minValue":' || cast(cast(round(c_acctbal) as bigint) as string) || ',"maxValue":"' || cast(cast(round(c_acctbal) as bigint) + 9 as string) || '","unitText":"MONTH"}}'
             else '{"currency":"VND","value":{"value":5,"unitText":"MONTH"}}' end || '}' end"""
    return r.table("customer").select("c_custkey", *(c.alias(k) for k, c in N.posting_salary_location(F.expr(text)).items()))


# whole profiles -------------------------------------------------------------------------------------------------------------

TOLD = "select distinct c_mktsegment as career_id, cast(r_regionkey as int) + 1 as rank, r_name as name, 'market' as origin from customer, region where (r_regionkey + length(c_mktsegment)) % 2 = 0"
SCORED = "select c_mktsegment as career_id, case c_nationkey % 4 when 0 then 'Social' when 1 then 'Artistic' when 2 then 'Realistic' else 'Unknown' end as element_name, c_acctbal as data_value from customer where c_mktsegment <> 'BUILDING'"
DESCRIBED = "select distinct c_mktsegment as career_id, n_name as onetsoc_code, 'about ' || n_name as description from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'MACHINERY'"


@query("C11_whole_profiles", f"""
with c as (select distinct c_mktsegment as career_id from customer union all select 'NONE'), a as (select * from ({JOBS}) j where is_active and career_id is not null),
k as (select career_id, count(distinct job_id) as posting_count, count(distinct company_name) as company_count, string_agg(distinct work_mode, ',' order by work_mode) as work_modes, string_agg(distinct province, ',' order by province) as provinces,
             median(case when salary_disclosed then salary_mid_vnd end) as pay, count(case when salary_disclosed then salary_mid_vnd end) as paid from a group by 1),
b as (select career_id, string_agg(coalesce(province, '-') || '/' || work_mode || '/' || posting_count || '/' || unique_company_count || '/' || salary_sample_size, ',' order by n) as breakdown from (select *, row_number() over (partition by career_id order by posting_count desc, province nulls last, work_mode, snapshot_version) as n from ({DEMAND}) d) x where n <= 20 group by 1),
s as (select career_id, string_agg(name, ',' order by rank) as skills from ({TOLD}) t group by 1),
m as (select career_id, element_name, round(avg(data_value), 3) as v, avg(data_value) as w, case element_name when 'Realistic' then 1 when 'Artistic' then 3 else 4 end as o from ({SCORED}) t where element_name <> 'Unknown' group by 1, 2),
i as (select career_id, string_agg(element_name[1:1] || '=' || v, ',' order by o) as scores, string_agg(element_name[1:1], '' order by w desc, o) as code from m group by 1),
o as (select career_id, string_agg(description, ' ' order by onetsoc_code) as described from ({DESCRIBED}) d group by 1), e as (select career_id, count(*) as n from ({JOBS}) j where province is null group by 1)
select career_id, coalesce(described, case when posting_count > 0 then 'Hồ sơ thị trường của ' || career_id || ' được tổng hợp từ ' || posting_count || ' tin tuyển dụng tại ' || company_count || ' doanh nghiệp trong các nguồn đang theo dõi.' else 'Chưa có đủ bằng chứng tuyển dụng hiện hành để mô tả chi tiết nghề ' || career_id || '.' end) as overview,
       coalesce(skills, '') as top_skills, coalesce(work_modes, '') as work_modes, coalesce(provinces, '') as provinces, coalesce(breakdown, '') as market_breakdown, coalesce(posting_count, 0) as posting_count, coalesce(company_count, 0) as company_count, scores as riasec_scores, coalesce(code, '') as riasec_code,
       round(pay, 6) as salary_median_vnd, coalesce(paid, 0) as salary_sample_size, coalesce(e.n, 0) as evidence_count, case when e.n > 0 then 'available' else 'insufficient_evidence' end as detail_status, '0.4.0:2026-01-02' as profile_version, '0.4.0' as taxonomy_version
from c left join k using (career_id) left join b using (career_id) left join s using (career_id) left join i using (career_id) left join o using (career_id) left join e using (career_id)""")
def _(r: Roles) -> DataFrame:
    careers = r.sql("select distinct c_mktsegment as career_id, c_mktsegment as career_name, cast(null as array<string>) as aliases from customer union all select 'NONE', 'NONE', null")
    tasks = r.spark.createDataFrame([], "career_id string, rank int, task string, origin string")
    used = ["job_id", "source_id", "source_job_id", "collected_at", "seq", *A.DEMAND_KEYS, "company_name", "salary_disclosed", "salary_mid_vnd", "overall_confidence", "posted_at", "is_active"]
    # read by five parts of a profile, each of which would join the source tables again
    jobs = kept(r["jobs"].select(*used), "jobs")
    proof = jobs.filter("province is null").select("career_id")
    found = C.whole_profiles(careers, jobs, A.demand_summary(jobs, "seq"), r.sql(TOLD), tasks, r.sql(SCORED), r.sql(DESCRIBED), proof, "0.4.0", "2026-01-02")
    row = F.transform("market_breakdown", lambda x: F.concat_ws("/", F.coalesce(x["province"], F.lit("-")), x["work_mode"], *(x[c].cast("string") for c in ("posting_count", "unique_company_count", "salary_sample_size"))))
    scores = F.array_join(F.transform(F.map_entries("riasec_scores"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    shown = {"top_skills": F.array_join(F.transform("top_skills", lambda x: x["name"]), ","), "work_modes": F.array_join("work_modes", ","), "provinces": F.array_join("provinces", ","), "market_breakdown": F.array_join(row, ","), "riasec_scores": scores}
    return found.withColumns(shown | {"salary_median_vnd": F.round("salary_median_vnd", 6)}).drop("title", "aliases", "typical_tasks")


# taxonomy, reports, market snapshot, adapters ----------------------------------------------------------------------------------


@query("S5_alias_dimension", """
with b as (select p_brand, row_number() over (order by p_brand) - 1 as k from (select distinct p_brand from part) x), a as (select p_brand, unnest([' ' || upper(p_brand) || ' ', 'the  ' || p_brand, ' ']) as raw, unnest([0, 1, 2]) as n from b)
select p_brand as id, 'Skill ' || p_brand as name, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) as alias, k as entity_ord, n as alias_ord from a join b using (p_brand) where trim(raw) <> ''""")
def _(r: Roles) -> DataFrame:
    """A taxonomy file of all brands, read and flattened."""
    path = work_dir(r.spark, "taxonomy")
    brands = r.sql("select p_brand as skill_id, concat('Skill ', p_brand) as canonical_name, array(concat(' ', upper(p_brand), ' '), concat('the  ', p_brand), ' ') as aliases from (select distinct p_brand from part) x")
    whole = brands.agg(F.to_json(F.struct(F.lit("0.4.0").alias("taxonomy_version"), F.sort_array(F.collect_list(F.struct("skill_id", "canonical_name", "aliases"))).alias("skills"))).alias("j"))
    whole.write.text(path)
    dim = M.alias_dim(S.read_taxonomy(r.spark, path, "skills"))
    return dim.select("id", "name", "alias", "entity_ord", "alias_ord")


@query("S8_report_sinks", f"select fmt, count(*) as n, cast(sum(k) as bigint) as skills, min(ids) as first from (select unnest(['json', 'csv']) as fmt, job_id, count(*) as k, '[\"' || string_agg(distinct skill_id, '\",\"' order by skill_id) || '\"]' as ids from ({SKILLS}) s group by job_id) x group by fmt")
def _(r: Roles) -> DataFrame:
    """A report with a nested column as JSON and as CSV, read back."""
    report = kept(r["skills"].groupBy("job_id").agg(F.count("*").alias("k"), F.sort_array(F.collect_set("skill_id")).alias("ids")), "report")
    out = None
    for fmt in ("json", "csv"):
        path = work_dir(r.spark, fmt)
        S.write_report(report, path, fmt)
        back = r.spark.read.schema("job_id string, k long, ids string").option("header", True).option("escape", "\\").format(fmt).load(path)
        row = back.agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.sum("k").alias("skills"), F.min("ids").alias("first"))
        out = row if out is None else out.unionByName(row)
    return out


@query("S13_market_snapshot", f"""
select 'observed' as data_mode, career_id, cast(sum(posting_count) as bigint) as sample_size from ({DEMAND}) d group by career_id
union all select 'fallback', c_mktsegment, count(*) from customer group by c_mktsegment""")
def _(r: Roles) -> DataFrame:
    """The published table where it is there and whole, the fallback where a column is missing."""
    path = work_dir(r.spark, "market")
    A.demand_summary(r["jobs"], "seq").write.parquet(path)
    fallback = r.sql("select c_mktsegment as career_id, count(*) as posting_count from customer group by c_mktsegment")
    every = [S.market_snapshot(r.spark, path, ["career_id", *more], fallback) for more in (["posting_count"], ["growth"])]
    rows = every[0].select("data_mode", "career_id", "posting_count").unionByName(every[1].select("data_mode", "career_id", "posting_count"))
    return rows.groupBy("data_mode", "career_id").agg(F.sum("posting_count").alias("sample_size"))


@query("F1_adapt_listing", """
select source, cast(doc_id as varchar) as source_job_id, lang as title_raw, case when length(trim(card)) > 0 then trim(card) || chr(10) || 'Kỹ năng:' || chr(10) || source || chr(10) || lang else 'Kỹ năng:' || chr(10) || source || chr(10) || lang end as description_raw, source as company_name_raw, cast('2026-01-02' as timestamp) as collected_at
from (select *, case when n_chars > 900 then '' else split_part(text, chr(10), 1) end as card from documents) d""")
def _(r: Roles) -> DataFrame:
    listed = r.sql("""
        select source, source as source_id, cast(doc_id as string) as source_job_id, cast(null as string) as source_url, lang as job_title_raw, source as company_name_raw, cast(null as string) as location_raw, cast(null as string) as salary_raw,
               to_json(array(source, ' ', lang)) as skills_raw, case when n_chars > 900 then '' else split_part(text, chr(10), 1) end as card_text_raw, '2026-01-02 00:00:00' as fetched_at from documents""")
    return J.adapt_listing(listed).select("source", "source_job_id", "title_raw", "description_raw", "company_name_raw", "collected_at")


# lineage and handoff --------------------------------------------------------------------------------------------------------------


@query("E7_ability_evidence", f"select student_id, skill_id, string_agg(evidence_id, ',' order by evidence_id) as evidence_ids from ({role_sql('evidence')}) e where skill_id not like 'INTEREST%' group by 1, 2")
def _(r: Roles) -> DataFrame:
    return E.ability_profile(r["evidence"], with_ids=True).select("student_id", "skill_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("E9_gap_evidence", f"""
with e as (select student_id, skill_id, string_agg(evidence_id, ', ' order by evidence_id) as ids from ({role_sql('evidence')}) e group by 1, 2)
select student_id, gap_id, priority, 'Mức hiện tại dưới ngưỡng; dựa trên evidence: ' || ids || '.' as reason from ({GAPS}) g join e using (student_id, skill_id)""")
def _(r: Roles) -> DataFrame:
    limits = r.spark.createDataFrame(LIMITS, "skill_id string, expected_level double, importance double, activity_id string, activity_minutes int")
    return E.academic_gaps(E.ability_profile(r["evidence"], with_ids=True), r["students"], limits).select("student_id", "gap_id", "priority", "reason")


@query("R1_career_handoff", f"""
with m as (select distinct career_id, skill_id from ({MATRIX}) m), k as (select profile_id, career_id, count(distinct skill_id) as n, string_agg(distinct skill_id, ',' order by skill_id) as ids from ({PROFILES}) p join m using (skill_id) group by 1, 2),
b as (select profile_id, arg_min(career_id, (-n, career_id)) as career_id from k group by 1), d as (select career_id, cast(sum(posting_count) as bigint) as n, case when min(snapshot_version) = max(snapshot_version) then min(snapshot_version) end as v from ({DEMAND}) d group by 1),
j as (select career_id, string_agg(job_id, ',' order by job_id) as jobs from (select career_id, job_id from ({JOBS}) j where is_active qualify row_number() over (partition by career_id order by job_id) <= 3) x group by 1)
select profile_id, b.career_id, k.ids as matched_skill_ids, d.n as market_posting_count, j.jobs as sample_job_ids, d.v as snapshot_version from b join k using (profile_id, career_id) left join d on d.career_id = b.career_id left join j on j.career_id = b.career_id""")
def _(r: Roles) -> DataFrame:
    found = C.career_handoff(r.sql(PROFILES), A.skill_matrix(r["skills"]), A.demand_summary(r["jobs"], "seq"), r["jobs"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("matched_skill_ids", "sample_job_ids")})


@query("A4_quality_report_versions", f"select count(*) as row_count, string_agg(distinct 'board ' || source_id, ',' order by 'board ' || source_id) as sources, string_agg(distinct work_mode, ',' order by work_mode) as taxonomy_version from ({JOBS}) j")
def _(r: Roles) -> DataFrame:
    """Sources and taxonomy versions as the postings have them."""
    jobs = r["jobs"].withColumns({"source": F.concat(F.lit("board "), "source_id"), "taxonomy_version": F.col("work_mode")})
    return A.quality_report(jobs).select("row_count", "sources", "taxonomy_version")
