"""Registered queries of questionnaires, packages of questions and report checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.operators import aggregate as A
from marketloom.operators import checks as V
from marketloom.operators import lookups as Q
from marketloom.plans.demo import Roles, role_sql
from marketloom.plans.registry import query
from marketloom.sources.versions import kept

JOBS, SKILLS = role_sql("jobs"), role_sql("skills")


@query("Q13_distinct_questions")
def _(r: Roles) -> DataFrame:
    """Turns of conversations in their order: one goes if a kept one before has its conversation or its text."""
    turns = r.table("conversations").select("conv_id", "turn", F.lower(F.coalesce(T.squeezed_or_null("text"), F.lit(""))).alias("prompt"))
    first = Q.keep_first(turns, ["conv_id", "prompt"], ["turn"])
    return first.select("conv_id", "turn", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


# answers made of events: each user's events of a kind of question are the answers ----------------------------------------

TYPED = """
select event_id as answer_id, 'q' || cast(event_id % 7 as string) as question_id, event_type as event, value as v,
       case event_id % 7 when 0 then event_type when 2 then cast(value as string) when 3 then cast(cast(floor(value) as int) % 8 as string) when 6 then event_type || ' ' || event_type || ' of ' || props end as value from events
"""


@query("V10_valid_answers", f"""
with a as ({TYPED})
select 'answer' as rule, cast(answer_id as varchar) as key, case question_id when 'q0' then 'choice' when 'q1' then 'multi_choice' when 'q2' then 'number' when 'q3' then 'likert' when 'q4' then 'ranking' when 'q5' then 'allocation' else 'text' end as detail
from a where case question_id when 'q0' then event not in ('view', 'click', 'signup') when 'q1' then event not in ('view', 'click') when 'q2' then v < 1 or v > 250 when 'q3' then cast(floor(v) as int) % 8 not between 1 and 5
  when 'q4' then event not in ('view', 'click') when 'q5' then abs(round(v) - 60) > 0.001 else event in ('purchase') end""")
def _(r: Roles) -> DataFrame:
    kinds = [
        ("q0", "choice", ["view", "click", "signup"], None, None, None), ("q1", "multi_choice", ["view", "click"], None, None, None), ("q2", "number", None, 1.0, 250.0, None), ("q3", "likert", None, 1.0, 5.0, None),
        ("q4", "ranking", ["view", "click"], None, None, None), ("q5", "allocation", ["x", "y"], None, None, None), ("q6", "text", None, None, 500.0, 5),
    ]
    questions = r.spark.createDataFrame(kinds, "question_id string, type string, options array<string>, low double, high double, max_words int")
    typed = r.sql(TYPED)
    other = F.when(F.col("event") == "view", "click").otherwise("view")
    points = F.array(F.concat(F.lit("x="), F.round("v").cast("long").cast("string")), F.lit("y=40"))
    items = F.when(F.col("question_id") == "q1", F.array("event")).when(F.col("question_id") == "q4", F.array("event", other)).when(F.col("question_id") == "q5", points)
    wordy = F.when((F.col("question_id") == "q6") & (F.col("event") == "purchase"), F.concat_ws(" ", "value", "value")).otherwise(F.col("value"))
    return V.valid_answers(typed.withColumn("items", items).withColumn("value", wordy), questions)


ANSWERED = "select cast(user_id as string) as submission_id, 'q' || cast(event_id % 6 as string) as question_id, max(event_type) as value from events group by 1, 2"
#: q1 is shown by q0, q2 by q1, q3 by q2; q4 by two others.
CONDITIONS = [("q1", "q0", "not_equals", "error"), ("q2", "q1", "in", "view|signup|purchase"), ("q3", "q2", "equals", "view"), ("q4", "q0", "equals", "view"), ("q4", "q1", "not_equals", "view")]
SHOWN = f"""
with a as ({ANSWERED}), w as (select distinct submission_id from a), p as (select w.submission_id, max(value) filter (question_id = 'q0') as q0, max(value) filter (question_id = 'q1') as q1, max(value) filter (question_id = 'q2') as q2 from w left join a using (submission_id) group by 1),
o as (select submission_id, coalesce(q0 <> 'error' and q0 <> '', false) as c1, coalesce(q1 in ('view', 'signup', 'purchase'), false) as c2, coalesce(q2 = 'view', false) as c3, coalesce(q0 = 'view', false) and coalesce(q1 <> 'view' and q1 <> '', false) as c4 from p)
select submission_id, unnest(['q1', 'q2', 'q3', 'q4']) as question_id, unnest([c1, c1 and c2, c1 and c2 and c3, c4 and c1]) as is_visible from o
"""


def _shown(r: Roles) -> DataFrame:
    return V.visible_chained(r.spark.createDataFrame(CONDITIONS, "question_id string, depends_on string, operator string, operand string"), r.sql(ANSWERED))


@query("F6_display_if_chained", SHOWN)
def _(r: Roles) -> DataFrame:
    return _shown(r)


@query("V11_submission", f"""
with a as ({ANSWERED}), v as ({SHOWN}), n as (select submission_id, question_id from (select distinct submission_id from a) s, (select unnest(['q0', 'q2', 'q3']) as question_id) q)
select 'submission:unknown' as rule, submission_id || '/' || question_id as key, 'unknown question' as detail from a where question_id = 'q5'
union all select 'submission:hidden', submission_id || '/' || question_id, 'answered but hidden' from a join v using (submission_id, question_id) where not is_visible
union all select 'submission:missing', submission_id || '/' || question_id, 'required' from n left join v using (submission_id, question_id) where coalesce(is_visible, true) and not exists (select 1 from a where a.submission_id = n.submission_id and a.question_id = n.question_id)""")
def _(r: Roles) -> DataFrame:
    asked = r.spark.createDataFrame([("q0", True), ("q1", False), ("q2", True), ("q3", True), ("q4", False)], "question_id string, required boolean")
    return V.submission(r.sql(ANSWERED), asked, _shown(r))


@query("V14_package_invariants", """
with i as (select l_orderkey as package_id, count(*) as n, sum(l_quantity) as s, max(l_linenumber) as d, count(distinct l_partkey) as u from lineitem group by 1),
p as (select o_orderkey as package_id, 1 + o_custkey % 7 as n_questions, round(o_totalprice / 1000) as total_score, 5 as max_difficulty, n, s, d, u from orders left join i on package_id = o_orderkey)
select 'package:count' as rule, cast(package_id as varchar) as key, 'package' as detail from p where n is distinct from n_questions
union all select 'package:score', cast(package_id as varchar), 'package' from p where abs(coalesce(s, 0) - total_score) > 1e-9
union all select 'package:difficulty', cast(package_id as varchar), 'package' from p where d > max_difficulty
union all select 'package:ids', cast(package_id as varchar), 'package' from p where u < n
union all select 'package:reused', cast(l_orderkey as varchar), cast(l_partkey as varchar) from lineitem where l_partkey in (select p_partkey from part where p_size = 1)
union all select 'package:options', cast(l_orderkey as varchar), cast(l_partkey as varchar) from lineitem where l_returnflag = l_linestatus or l_returnflag = 'N' or l_linestatus = 'N' or l_returnflag not in (l_linestatus, 'N', 'R')""")
def _(r: Roles) -> DataFrame:
    packages = r.sql("select o_orderkey as package_id, 1 + o_custkey % 7 as n_questions, round(o_totalprice / 1000) as total_score, 5 as max_difficulty from orders")
    items = r.sql("select l_orderkey as package_id, l_partkey as item_id, l_quantity as score, l_linenumber as difficulty, l_partkey as fingerprint, array(l_returnflag, l_linestatus, 'N') as options, case when l_returnflag in (l_linestatus, 'R') then l_returnflag else 'none' end as answer from lineitem")
    return V.package_invariants(packages, items, r.sql("select p_partkey as fingerprint from part where p_size = 1"))


COUNTS = "count(*) as n, count(*) filter (salary_disclosed) as paid, count(*) filter (work_mode = 'REMOTE') as remote, count(*) filter (job_id in (select job_id from ({}) s)) as skilled"


@query("V12_report_differences", f"""
with w as (select {COUNTS.format(SKILLS)} from ({JOBS}) j), a as (select {COUNTS.format(SKILLS).replace('count(*) filter (job_id', 'count(distinct job_id) filter (job_id')} from ({JOBS}) j where is_active),
d as (select source_id, count(*) as n, count(*) filter (is_active) as m from ({JOBS}) j group by 1)
select 'differs:' || f as rule, '' as key, x || '/' || y as detail from (
  select unnest(['salary_available_count', 'remote_job_count', 'jobs_with_mapped_skills', 'total_current_jobs']) as f, unnest([w.paid, w.remote, w.skilled, w.n]) as x, unnest([a.paid, a.remote, a.skilled, a.n]) as y from w, a) t where x <> y
union all select 'differs:source_distribution', source_id, n || '/' || case when m > 0 then cast(m as varchar) else 'null' end from d where n <> m""")
def _(r: Roles) -> DataFrame:
    """The coverage report of all postings against figures worked out from the active ones."""
    collectors = r.sql("select distinct l_linestatus as source_id, l_returnflag as collector_version from lineitem")
    states = r.sql("select 'active' as lifecycle_status from events")
    used = ["job_id", "source_id", "source_job_id", "career_id", "province", "snapshot_version", "work_mode", "company_name", "salary_disclosed", "overall_confidence", "is_active"]
    # both reports read them several times, and would join the source tables again each time
    jobs, skills = kept(r["jobs"].select(*used), "jobs"), kept(r["skills"].select("job_id"), "skills")
    report = A.coverage_report(jobs.withColumn("description_clean", F.col("company_name")), skills, states, collectors, "0.4.0")
    active = jobs.filter("is_active")
    per = active.groupBy("source_id").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("source_id", "n"))).alias("sources"))
    metrics = V.production_metrics(active, skills.join(active.select("job_id"), "job_id", "left_semi")).withColumn("taxonomy", F.lit("0.4.0")).crossJoin(per)  # one row beside one row
    metrics = metrics.withColumn("valid", F.lit(r.table("events").count()))
    fields = {
        "salary_available_count": "salary_disclosed", "remote_job_count": "remote", "jobs_with_mapped_skills": "jobs_with_skill", "total_current_jobs": "job_count", "source_distribution": "sources", "taxonomy_version": "taxonomy",
        "total_lifecycle_records": "valid",
    }
    return V.report_differences(report, metrics, fields)


# structure of tables ---------------------------------------------------------------------------------------------------------


@query("V1_required_columns", "select 'required_column' as rule, c as key, 'missing' as detail from (select unnest(['doc_id', 'title', 'text', 'url']) as c) x where c not in (select column_name from (describe select * from documents))")
def _(r: Roles) -> DataFrame:
    return V.required_columns(r.table("documents"), ["doc_id", "title", "text", "url"])


@query("V8_taxonomy_structure", """
with e as (select case when p_size > 48 then 'X' else 'SKILL_' end || p_partkey // 2 as id, case when p_size = 1 then ' ' else p_name end as name, case when p_size = 2 then [] when p_size = 3 then [p_name, upper(p_name) || ' '] when p_size = 4 then [p_name, ''] else [p_name, p_brand] end as aliases from part)
select 'unique:id' as rule, id as key, cast(count(*) as varchar) as detail from e group by id having count(*) > 1
union all select 'taxonomy:prefix', id, 'SKILL_' from e where not starts_with(id, 'SKILL_')
union all select 'not_blank:name', id, 'null or blank' from e where trim(name) = ''
union all select 'taxonomy:no_alias', id, 'no alias' from e where len(aliases) = 0
union all select 'taxonomy:blank_alias', id, 'blank' from (select id, unnest(aliases) as a from e) x where trim(a) = ''
union all select 'taxonomy:repeated_alias', id, a from (select id, lower(trim(unnest(aliases))) as a from e) x group by id, a having count(*) > 1""")
def _(r: Roles) -> DataFrame:
    aliases = "case when p_size = 2 then cast(array() as array<string>) when p_size = 3 then array(p_name, upper(p_name) || ' ') when p_size = 4 then array(p_name, '') else array(p_name, p_brand) end"
    entities = r.sql(f"select case when p_size > 48 then 'X' else 'SKILL_' end || cast(p_partkey div 2 as string) as id, case when p_size = 1 then ' ' else p_name end as name, {aliases} as aliases from part")
    return V.taxonomy_structure(entities, "SKILL_")


@query("V9_learner_profile", """
with p as (select c_custkey as id, 'Brand#' || (c_custkey % 40) as skill, c_mktsegment as mode, n_name from customer join nation on c_nationkey = n_nationkey)
select 'profile:skill' as rule, cast(id as varchar) as key, skill as detail from p where skill not in (select p_brand from part)
union all select 'profile:province', cast(id as varchar), ' ' || upper(n_name) from p where n_name not in (select n_name from nation join region on n_regionkey = r_regionkey where r_regionkey < 3)
union all select 'domain:mode', cast(id as varchar), mode from p where mode not in ('BUILDING', 'MACHINERY')""")
def _(r: Roles) -> DataFrame:
    profiles = r.sql("select c_custkey as id, array('Brand#' || cast(c_custkey % 40 as string)) as skill_ids, array(' ' || upper(n_name)) as provinces, c_mktsegment as mode from customer join nation on c_nationkey = n_nationkey")
    skills = r.sql("select distinct p_brand as id, lower(p_brand) as alias from part")
    places = r.sql("select n_name as id, lower(n_name) as alias from nation join region on n_regionkey = r_regionkey where r_regionkey < 3")
    return V.learner_profile(profiles, skills, places, ["BUILDING", "MACHINERY"])
