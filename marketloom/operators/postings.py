"""From raw rows of a source to cleaned postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import normalize as N
from marketloom.functions.text import clean_text, col, content_hash, cross_source_key, dedup_group_id, job_id, text_or_empty
from marketloom.operators.dedup import with_duplicate_count
from marketloom.operators.matching import extract_skills, match_career
from marketloom.sources.versions import kept


def parse_tags(tags: str | Column) -> Column:
    """F2. Tags of a JSON array, cleaned, each once in order; anything else gives none."""
    parsed = F.from_json(text_or_empty(tags), "array<string>")
    clean = F.transform(parsed, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_distinct(F.filter(F.coalesce(clean, F.array().cast("array<string>")), lambda x: x != ""))


RAW = ["source", "source_id", "source_job_id", "source_url", "title_raw", "company_name_raw", "description_raw", "location_raw", "work_mode_raw", "salary_raw", "experience_raw", "education_raw", "posted_at_raw", "collected_at"]


def adapt_board(df: DataFrame) -> DataFrame:
    """F1. Rows of ``flatten_board_payload`` in the common schema."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    return df.select("source", "source_id", "source_job_id", "source_url", "title_raw", F.col("source_id").alias("company_name_raw"), "description_raw", "location_raw", none("work_mode_raw"), none("salary_raw"), none("experience_raw"), none("education_raw"), F.col("source_updated_at").alias("posted_at_raw"), F.col("fetched_at").cast("timestamp").alias("collected_at"))


def adapt_listing(df: DataFrame) -> DataFrame:
    """F1. Rows of a listing in the common schema; the text is the card and its tags, or else the title."""
    tags = parse_tags("skills_raw")
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("Kỹ năng:\n"), F.array_join(tags, "\n")))
    text = F.nullif(F.concat_ws("\n", F.nullif(F.trim(text_or_empty("card_text_raw")), F.lit("")), listed), F.lit(""))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return df.select("source", "source_id", "source_job_id", "source_url", F.col("job_title_raw").alias("title_raw"), "company_name_raw", F.coalesce(text, F.col("job_title_raw")).alias("description_raw"), "location_raw", none("work_mode_raw"), "salary_raw", none("experience_raw"), none("education_raw"), none("posted_at_raw"), F.col("fetched_at").cast("timestamp").alias("collected_at"))


def user_segment(role, stage, major_career, career, target) -> Column:
    """F7. One of five segments: by role and stage, and whether a student's major or a worker's career is the target."""
    is_target = lambda c: F.coalesce((text_or_empty(c) != "") & (col(c) == col(target)), F.lit(False))
    student = F.when(F.coalesce(col(stage) == "HIGH_SCHOOL", F.lit(False)), "HS_FOUNDATION").when(is_target(major_career), "SV_SAME_MAJOR").otherwise("SV_DIFF_MAJOR")
    worker = F.when(is_target(career), "WORKER_SAME_FIELD").otherwise("WORKER_DIFF_FIELD")
    return F.when(col(role) == "STUDENT", student).when(col(role) == "PROFESSIONAL", worker).otherwise("HS_FOUNDATION")


def process_postings(raw: DataFrame, careers: DataFrame, skills: DataFrame, locations: DataFrame, snapshot_version: str, markup: bool = True) -> DataFrame:
    """M9. Cleaned postings with keys, normalised fields, career and nested skills.

    What a posting's text decides is worked out in its row, and skills where the text is read; the rows that are joined have
    no text. A posting has the skills of its own text: rows of one ``job_id`` share them if they share the content hash.
    """
    hash_ = content_hash("title_raw", "company_name_raw", "location_raw", "description_raw", markup)
    hashed = raw.select(*RAW).withColumn("content_hash", hash_).withColumn("job_id", job_id("source", "source_job_id", "source_url", "content_hash"))
    rows = kept(hashed.select(
        "job_id", "content_hash", "source", "source_id", "source_job_id", "source_url", "title_raw", "company_name_raw", "location_raw", "collected_at", dedup_group_id("content_hash").alias("dedup_group_id"),
        N.work_mode("work_mode_raw", "location_raw", "description_raw", markup).alias("work_mode"), N.salary("salary_raw", markup).alias("_pay"),
        N.seniority(F.coalesce(F.nullif(F.col("experience_raw"), F.lit("")), F.col("description_raw")), markup).alias("seniority_level"), N.experience_years("description_raw", markup).alias("experience_min_years"),
        N.education("education_raw", markup).alias("education_level"), N.posted_date("posted_at_raw", "collected_at", markup).alias("posted_at"), F.substring(text_or_empty("description_raw"), 1, 1).alias("_said"),
    ), "postings")
    placed = N.province(match_career(rows, "title_raw", careers, markup), "location_raw", locations, "province", markup)
    found = extract_skills(hashed.select(F.struct("job_id", "content_hash").alias("_key"), "description_raw"), "_key", "description_raw", skills, "required", markup)
    nested = found.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("skill_id", "skill_name", "raw_mention", "requirement_level", "confidence"))).alias("skills"))
    nested = nested.select("_key.job_id", "_key.content_hash", "skills")
    joined = with_duplicate_count(placed.join(nested, ["job_id", "content_hash"], "left"), "content_hash")
    return joined.select(
        "job_id", "source", "source_id", "source_job_id", "source_url", F.col("title_raw").alias("job_title_raw"), clean_text("company_name_raw").alias("company_name") if markup else F.col("company_name_raw").alias("company_name"),
        "career_id", "career_name", "career_confidence", "province", "work_mode",
        F.col("_pay.min_vnd").alias("salary_min_vnd"), F.col("_pay.max_vnd").alias("salary_max_vnd"), F.col("_pay.mid_vnd").alias("salary_mid_vnd"), F.col("_pay.disclosed").alias("salary_disclosed"),
        "seniority_level", "experience_min_years", "education_level",
        "posted_at", "collected_at", "content_hash", "dedup_group_id", cross_source_key("company_name_raw", "title_raw", "province", markup).alias("cross_source_key"), "duplicate_count",
        N.overall_confidence("career_confidence", "province", F.size("skills"), "_said").alias("overall_confidence"), N.source_confidence("source").alias("source_confidence"), "skills", F.lit(snapshot_version).alias("snapshot_version"), F.lit(True).alias("is_active"),
    )
