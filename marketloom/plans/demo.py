"""The driver's tables in the roles of postings, skills and learners: SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ROLES = {
    # line items as postings: several of one order share an identity; the one shipped last counts
    "jobs": """
select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as job_id,
       l_linestatus as source_id, cast(l_orderkey as string) as source_job_id,
       c_mktsegment as career_id, c_mktsegment as career_name, nullif(n_name, 'NATION_7') as province,
       case when o_orderpriority = '1-URGENT' then 'REMOTE' else o_orderpriority end as work_mode,
       c_name as company_name, l_extendedprice as salary_mid_vnd, l_discount > 0 as salary_disclosed,
       cast(o_orderdate as date) as posted_at, l_shipdate as collected_at,
       l_partkey * 100000 + l_suppkey * 10 + l_linenumber as seq,
       l_quantity / 50 as overall_confidence, l_returnflag <> 'R' as is_active, 'v1' as snapshot_version,
       case when l_tax > 0.02 then 'h' || cast(l_partkey as string) else 'h0' end as content_hash
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
""",
    # their parts as skills
    "skills": """
select j.job_id, 'g' || j.source_job_id as dedup_group_id, j.career_id, j.province, j.work_mode, p_brand as skill_id, 'Skill ' || p_brand as skill_name,
       case j.source_id when 'F' then 'required' else case when j.salary_disclosed then 'preferred' else 'not_required' end end as requirement_level
from (select *, cast(split_part(job_id, '-', 3) as bigint) as partkey from ({jobs}) x) j join part on j.partkey = p_partkey
""",
    # events as evidence of learners
    "evidence": """
select cast(user_id as string) as student_id, 'EV' || cast(event_id as string) as evidence_id,
       case event_type when 'purchase' then 'assessment' when 'view' then 'academic_record' when 'click' then 'teacher_observation' when 'signup' then 'activity_result' else 'self_report' end as source_type,
       case when event_id % 11 = 0 then 'INTEREST_' else 'SKILL_' end || cast(event_id % 5 as string) as skill_id,
       value / 500 as normalized_value, cast(1 as double) as confidence, ts as observed_at
from events
""",
    "students": """
select cast(user_id as string) as student_id, cast(min(event_id) % 60 as int) as weekly_available_minutes, min(event_id) % 3 = 0 as exam_week from events group by user_id
""",
    "results": """
select cast(user_id as string) as student_id, cast(event_id as string) as activity_result_id, 'G' || cast(event_id % 4 as string) as career_group_id, 'ACT' || cast(event_id % 4 as string) as activity_id,
       event_type <> 'error' as completed, value as rubric_score, cast(500 as double) as max_score,
       value / 2 as interest_before, value as interest_after, cast(500 as double) as interest_max_score
from events where event_type in ('signup', 'error')
""",
    # first lines of documents as titles
    "posts": """
select doc_id, source, lang, split_part(text, chr(10), 1) as title, text from documents
""",
}


def role_sql(name: str) -> str:
    """The SQL of a role, with those it rests on."""
    sql = ROLES[name]
    for other in ROLES:
        if f"{{{other}}}" in sql:
            sql = sql.replace(f"{{{other}}}", role_sql(other))
    return sql


class Roles:
    """Tables of one folder, as they are and in their roles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **instead: DataFrame) -> DataFrame:
        """Any of the shared SQL over this folder's tables, or those given ``instead`` by their names."""
        for t in TABLES:
            if t in text:
                instead.get(t, self.table(t)).createOrReplaceTempView(t)
        return self.spark.sql(text)

    def __getitem__(self, name: str) -> DataFrame:
        return self.sql(role_sql(name))

    def skills_of(self, jobs: DataFrame) -> DataFrame:
        """The skills of postings that are there already."""
        jobs.createOrReplaceTempView("jobs")
        return self.sql(ROLES["skills"].replace("{jobs}", "select * from jobs"))
