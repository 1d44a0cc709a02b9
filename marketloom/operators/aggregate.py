"""Demand summaries, skill matrices, quality and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.operators.dedup import dedup_last

DEMAND_KEYS = ["career_id", "career_name", "province", "work_mode", "snapshot_version"]
MATRIX_KEYS = ["career_id", "province", "work_mode"]
LEVELS = ["required", "preferred", "mentioned"]


def active_jobs(jobs: DataFrame) -> DataFrame:
    """F4. Rows that are active and not invalid; an unknown status is kept. Missing columns don't filter."""
    if "is_active" in jobs.columns:
        jobs = jobs.filter(F.coalesce("is_active", F.lit(False)))
    if "lifecycle_status" in jobs.columns:
        jobs = jobs.filter(F.coalesce(F.col("lifecycle_status") != "invalid", F.lit(True)))
    return jobs


def spread_median(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``keys, median, n``: the exact median of ``value`` in each group, null keys alike; null values don't count.

    Equal values are counted first, and only the counts are put in order, so that no group's values are gathered.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), value.cast("double").alias("_v")).filter("_v is not null").groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*names).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(W.partitionBy(*names))})
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = lambda at: F.when((F.col("_upto") >= at) & (F.col("_upto") - F.col("_c") < at), F.col("_v"))
    return placed.groupBy(*names).agg(((F.max(holds(low)) + F.max(holds(high))) / 2).alias("median"), F.max("_n").alias("n"))


def _with_median(df: DataFrame, keys: list[str], median: DataFrame) -> DataFrame:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(median[f"_k{i}"])
    joined = df.join(median, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    return joined.withColumnsRenamed({"median": "salary_median_vnd", "n": "salary_sample_size"}).withColumn("salary_sample_size", F.coalesce("salary_sample_size", F.lit(0)))


def _demand_rows(jobs: DataFrame, seq_col: str | None, keys: list[str]) -> DataFrame:
    identity, order = ["source_id", "source_job_id"], ["collected_at", seq_col or "job_id"]
    used = list(dict.fromkeys([*identity, *order, *keys, "career_id", "company_name", "salary_disclosed", "salary_mid_vnd", "overall_confidence", "posted_at"]))
    # postings are counted by whether they have an id: the ids themselves would be most of what is shuffled
    rows = active_jobs(jobs).select(*used, F.col("job_id").isNotNull().alias("_has_id"))
    return dedup_last(rows, identity, order).filter(F.col("career_id").isNotNull())


def _demand_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count_if("_has_id").alias("posting_count"),
        F.count_distinct("company_name").alias("unique_company_count"),
        F.avg("overall_confidence").alias("average_confidence"),
        F.min("posted_at").alias("data_from"),
        F.max("posted_at").alias("data_to"),
    )


def demand_counts(jobs: DataFrame, seq_col: str | None = None, keys: list[str] = DEMAND_KEYS) -> DataFrame:
    """The rows of ``demand_summary`` without pay, whose medians need the postings once more."""
    return _demand_groups(_demand_rows(jobs, seq_col, keys), keys)


def demand_summary(jobs: DataFrame, seq_col: str | None = None, keys: list[str] = DEMAND_KEYS) -> DataFrame:
    """A1. Postings, companies, median disclosed pay, confidence and dates for each career, place and mode.

    Active jobs only, the last collected row of each posting, ties to the larger ``seq_col`` or else ``job_id``; null
    places and modes are groups of their own.
    """
    rows = _demand_rows(jobs, seq_col, keys)
    pay = F.when(F.coalesce("salary_disclosed", F.lit(False)), F.col("salary_mid_vnd"))
    found = _with_median(_demand_groups(rows, keys), keys, spread_median(rows, keys, pay))
    return found.select(*keys, "posting_count", "unique_company_count", "salary_median_vnd", "salary_sample_size", "average_confidence", "data_from", "data_to")


def skill_matrix(skills: DataFrame, jobs: DataFrame | None = None, strict_parity: bool = True) -> DataFrame:
    """A2. Distinct dedup groups for each career, place, mode and skill, at the levels that ask for the skill.

    A group's skill counts once, with its smallest row by the keys. Unless ``strict_parity``, only skills of active
    ``jobs`` count, so that no share exceeds 1.
    """
    rows = skills.filter(F.col("requirement_level").isin(LEVELS))
    if not strict_parity:
        rows = rows.join(active_jobs(jobs).select("job_id"), "job_id", "left_semi")
    value = F.struct(*MATRIX_KEYS, "skill_name")
    once = rows.groupBy("dedup_group_id", "skill_id").agg(F.min(value).alias("v")).select("skill_id", "v.*")
    return once.groupBy(*MATRIX_KEYS, "skill_id", "skill_name").agg(F.count("*").alias("skill_posting_count"))


def skill_share(matrix: DataFrame, demand: DataFrame) -> DataFrame:
    """A3. Share of a group's postings that ask for each skill; null places and modes match each other."""
    d = demand.select(*(F.col(k).alias(f"_{k}") for k in MATRIX_KEYS), "posting_count")
    same = F.lit(True)
    for k in MATRIX_KEYS:
        same = same & matrix[k].eqNullSafe(d[f"_{k}"])
    joined = matrix.join(d, same, "left").drop(*(f"_{k}" for k in MATRIX_KEYS))
    return joined.withColumn("share_of_career_jobs", F.col("skill_posting_count") / F.col("posting_count"))


def rate(part: Column, whole: Column) -> Column:
    """A rate of four places; null over nothing."""
    return F.round(F.try_divide(part, whole), 4)


def quality_report(jobs: DataFrame, taxonomy_version: str | None = None) -> DataFrame:
    """A4. One row: sizes, duplicates, mapped fields, pay, sources, and the versions of snapshot and taxonomy.

    Sources are those of ``source`` where jobs have it, else of ``source_id``. Taxonomy versions are read from the jobs where
    they have them and none is given.
    """
    identity = F.struct("source_id", "source_job_id")
    held = F.array_join(F.array_sort(F.collect_set("taxonomy_version")), ",") if taxonomy_version is None and "taxonomy_version" in jobs.columns else F.max(F.lit(taxonomy_version))
    return jobs.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("content_hash").alias("distinct_hashes"),
        (F.count("*") - F.count_distinct(identity)).alias("duplicate_identities"),
        F.count("career_id").alias("mapped_careers"),
        F.count("province").alias("mapped_locations"),
        F.count_if(F.col("work_mode") == "REMOTE").alias("remote_jobs"),
        F.count_if(F.coalesce("salary_disclosed", F.lit(False))).alias("salary_disclosed"),
        F.round(F.avg("overall_confidence"), 3).alias("mean_confidence"),
        F.array_join(F.array_sort(F.collect_set("source" if "source" in jobs.columns else "source_id")), ",").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("snapshot_version")), ",").alias("snapshot_versions"),
        held.alias("taxonomy_version"),
    )


def coverage(jobs: DataFrame, skills: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A5, A6. Mapping rates of all jobs, or by source: careers, places (of jobs not remote), skills, confidence."""
    with_skill = skills.select("job_id").distinct().withColumn("has_skill", F.lit(True))
    rows = jobs.join(with_skill, "job_id", "left")
    remote = F.coalesce(F.col("work_mode") == "REMOTE", F.lit(False))
    n, placed = F.count("*"), F.count_if(~remote & F.col("province").isNotNull())
    measures = [
        n.alias("job_count"),
        F.count_if(remote).alias("remote_count"),
        rate(F.count("career_id"), n).alias("career_rate"),
        rate(placed, F.count_if(~remote)).alias("location_rate"),
        rate(F.count("has_skill"), n).alias("skill_rate"),
        rate(F.count_if(F.coalesce("salary_disclosed", F.lit(False))), n).alias("salary_rate"),
        F.round(F.avg("overall_confidence"), 4).alias("mean_confidence"),
    ]
    return rows.groupBy(*by).agg(*measures) if by else rows.agg(*measures)


def status_counts(state: DataFrame, col: str = "lifecycle_status") -> DataFrame:
    """L5, A5. Rows of each status, unknown ones too."""
    return state.groupBy(col).agg(F.count("*").alias("n"))


def coverage_report(jobs: DataFrame, skills: DataFrame, lifecycle: DataFrame, collectors: DataFrame, taxonomy_version: str | None) -> DataFrame:
    """A5. One row: the counts and rates of all current jobs, of their lifecycle, and of their sources.

    ``lifecycle`` has ``lifecycle_status``; ``collectors`` has ``source_id`` and ``collector_version``. Distributions and
    means by source are maps; versions are sorted lists.
    """
    remote = F.coalesce(F.col("work_mode") == "REMOTE", F.lit(False))
    disclosed, described = F.coalesce("salary_disclosed", F.lit(False)), F.trim(F.coalesce("description_clean", F.lit(""))) != ""
    conf = F.col("overall_confidence").cast("double")
    # few groups, which the tasks add up; then one row a source, then one row
    few = jobs.groupBy("source_id", "career_id", "province", "snapshot_version").agg(
        F.count("*").alias("n"),
        F.count_if(remote).alias("remote"),
        F.count_if(disclosed).alias("disclosed"),
        F.count_if(described).alias("described"),
        F.sum(conf).alias("conf"),
        F.count(conf).alias("n_conf"),
    )
    non_remote = F.col("n") - F.col("remote")
    counts = {
        "n": F.col("n"), "remote": F.col("remote"), "disclosed": F.col("disclosed"), "described": F.col("described"), "conf": F.col("conf"), "n_conf": F.col("n_conf"), "non_remote": non_remote,
        "unplaced": F.when(F.col("province").isNull(), non_remote).otherwise(0), "mapped": F.when(F.col("career_id").isNotNull(), F.col("n")).otherwise(0),
    }
    sets = ["career_id", "province", "snapshot_version"]
    per = few.groupBy("source_id").agg(*(F.sum(c).alias(k) for k, c in counts.items()), *(F.collect_set(c).alias(c) for c in sets))
    of_source = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("source_id").isNotNull(), F.struct("source_id", value.alias("v"))))))
    sums = per.agg(
        *(F.sum(k).alias(k) if k == "conf" else F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counts),
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in sets),
        of_source(F.col("n")).alias("by_n"),
        of_source(F.round(F.col("conf") / F.nullif(F.col("n_conf"), F.lit(0)), 4)).alias("by_conf"),
    )
    # apart from the counts and from one another, so that rows keep the order in which companies and identities lie together
    companies = jobs.agg(F.count_distinct("company_name").alias("companies"), F.count_distinct(F.struct("source_id", "source_job_id")).alias("identities"))
    skilled = jobs.filter(F.col("job_id").isNotNull()).select("job_id").join(skills.select("job_id"), "job_id", "left_semi").agg(F.count("*").alias("n"))
    found = sums.withColumns({"_u": companies.select(F.struct("companies", "identities")).scalar(), "_s": skilled.scalar()})
    n = F.col("n")
    one = found.select(
        n.alias("total_current_jobs"),
        F.col("_u.companies").alias("unique_companies"),
        F.size("career_id").cast("long").alias("unique_careers"),
        F.size("province").cast("long").alias("unique_provinces"),
        F.col("remote").alias("remote_job_count"),
        F.col("unplaced").alias("unknown_location_count"),
        F.col("disclosed").alias("salary_available_count"),
        rate(F.col("disclosed"), n).alias("salary_available_rate"),
        rate(F.col("described"), n).alias("description_available_rate"),
        rate(F.col("mapped"), n).alias("career_mapping_rate"),
        rate(F.col("non_remote") - F.col("unplaced"), F.col("non_remote")).alias("location_mapping_rate_non_remote"),
        F.col("_s").alias("jobs_with_mapped_skills"),
        rate(F.col("_s"), n).alias("skill_mapping_rate"),
        (n - F.col("_u.identities")).alias("duplicate_count"),
        F.round(F.col("conf") / F.nullif(F.col("n_conf"), F.lit(0)), 4).alias("average_extraction_confidence"),
        F.array_sort("snapshot_version").alias("snapshot_versions"),
        F.col("by_n").alias("source_distribution"),
        F.col("by_conf").alias("average_extraction_confidence_by_source"),
    )
    status = F.col("lifecycle_status")
    valid = F.coalesce(status != "invalid", F.lit(True))
    states = lifecycle.agg(
        F.count("*").alias("total_lifecycle_records"),
        F.count_if(valid).alias("valid_lifecycle_records"),
        F.count_if(~valid).alias("invalid_records_excluded"),
        *(F.count_if(status == s).alias(f"{s}_jobs") for s in ("active", "missing_unconfirmed", "inactive")),
    )
    as_map = lambda key, value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
    made = collectors.groupBy("source_id").agg(F.array_sort(F.collect_set("collector_version")).alias("v")).agg(as_map("source_id", "v").alias("collector_versions"))
    # each side is one row
    maps = ["source_distribution", "average_extraction_confidence_by_source"]
    rows = one.crossJoin(states).crossJoin(made)
    return rows.select(*(c for c in one.columns if c not in maps), *states.columns, *maps, "collector_versions", F.lit(taxonomy_version).alias("taxonomy_version"))


def tag_frequency(tags: DataFrame, skills: DataFrame) -> DataFrame:
    """A7. How often each raw tag occurs, and the skills it maps to: ids in order, their names beside them, and categories.

    ``skills``: ``tag, skill_id, skill_name, category`` (null: ``unspecified``).
    """
    counts = tags.filter(F.col("tag").isNotNull() & (F.col("tag") != "")).groupBy("tag").agg(F.count("*").alias("n"))
    named = skills.groupBy("tag", "skill_id").agg(F.min("skill_name").alias("skill_name"), F.collect_set(F.coalesce("category", F.lit("unspecified"))).alias("categories"))
    known = named.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("skill_id", "skill_name"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("c"))
    listed = lambda field: F.array_join(F.transform("s", lambda x: F.coalesce(x[field], F.lit(""))), " | ")
    shown = known.select("tag", listed("skill_id").alias("skill_ids"), listed("skill_name").alias("skill_names"), F.array_join("c", " | ").alias("skill_categories"))
    return counts.join(shown, "tag", "left").withColumn("is_mapped", F.col("skill_ids").isNotNull())


def taxonomy_gaps(jobs: DataFrame, tag_map: DataFrame, least_confidence: float = 0.9) -> DataFrame:
    """A8. ``job_id, gap, location_status``: jobs without a sure career, with unmapped tags, or without a place.

    A known career of unknown confidence is no gap. All jobs without a place are listed; ``location_status`` says whether
    they are ``remote`` or the place is ``unknown``. ``tag_map`` holds ``job_id, tag, is_mapped``.
    """
    gap = lambda df, kind, status=F.lit(None).cast("string"): df.select("job_id", F.lit(kind).alias("gap"), status.alias("location_status"))
    career = jobs.filter(F.col("career_id").isNull() | F.coalesce(F.col("career_confidence") < least_confidence, F.lit(False)))
    place = jobs.filter(F.col("province").isNull())
    skill = tag_map.filter(~F.coalesce("is_mapped", F.lit(False)) & (F.coalesce("tag", F.lit("")) != "")).select("job_id").distinct()
    remote = F.when(F.coalesce(F.col("work_mode") == "REMOTE", F.lit(False)), "remote").otherwise("unknown")
    return gap(career, "career").unionByName(gap(place, "location", remote)).unionByName(gap(skill, "skill"))


def simple_matrix(skills: DataFrame) -> DataFrame:
    """A9. Share of a career's jobs that name each skill."""
    once = skills.select("career_id", "skill_id", "job_id").distinct()
    per_skill = once.groupBy("career_id", "skill_id").agg(F.count("job_id").alias("skill_jobs"))
    per_career = once.select("career_id", "job_id").distinct().groupBy("career_id").agg(F.count("job_id").alias("career_jobs"))
    return per_skill.join(per_career, "career_id").withColumn("share", F.col("skill_jobs") / F.col("career_jobs"))


def market_groups(demand: DataFrame, matrix: DataFrame, jobs: DataFrame, job_skills: DataFrame, mapping: DataFrame, foundation: DataFrame, mapping_version: str) -> DataFrame:
    """A10. The market of each career group: postings, foundation skills, snapshot and taxonomy.

    ``mapping``: ``career_group_id, display_name, career_id``; ``foundation``: ``skill_id, foundation_skill_id``, the allowed
    ones only. Skills are those of the matrix and of the jobs. A group without demand, without a foundation skill or
    without a snapshot raises an error when it is read.
    """
    groups = mapping.groupBy("career_group_id", "display_name").agg(F.count("*").alias("_n")).drop("_n")
    of = mapping.select("career_group_id", "career_id").distinct()
    sums = demand.join(of, "career_id").groupBy("career_group_id").agg(
        F.sum(F.coalesce("posting_count", F.lit(0))).alias("sample_size"),
        F.max("snapshot_version").alias("_snapshot"),
        F.array_join(F.array_sort(F.collect_set("career_id")), ", ").alias("_mapped"),
    )
    asked = matrix.select("career_id", "skill_id").union(job_skills.select("career_id", "skill_id")).distinct()
    skills = asked.join(of, "career_id").join(foundation, "skill_id").groupBy("career_group_id").agg(F.array_sort(F.collect_set("foundation_skill_id")).alias("foundation_skill_ids"))
    # one row a career first, as all jobs would be shuffled by their few careers
    newest = jobs.groupBy("career_id").agg(F.max("taxonomy_version").alias("taxonomy_version"))
    taxonomy = newest.join(of, "career_id").groupBy("career_group_id").agg(F.max("taxonomy_version").alias("taxonomy_version"))
    joined = groups.join(sums, "career_group_id", "left").join(skills, "career_group_id", "left").join(taxonomy, "career_group_id", "left")
    need = lambda c, what: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"{what} mapped for "), "career_group_id")))
    n = need("sample_size", "no demand rows")
    return joined.select(
        "career_group_id",
        "display_name",
        # fixed value: the sentence that describes a group's market
        F.concat(n.cast("string"), F.lit(" lượt tin trong snapshot; mapping từ "), "_mapped", F.lit(".")).alias("market_signal"),
        n.alias("sample_size"),
        need("foundation_skill_ids", "no foundation skills").alias("foundation_skill_ids"),
        F.concat(need("_snapshot", "no snapshot version"), F.lit("|"), F.lit(mapping_version)).alias("snapshot_version"),
        "taxonomy_version",
    )


def grade_tests(tests: DataFrame, questions: DataFrame, answers: DataFrame, test: list[str], by: list[str]) -> DataFrame:
    """A11. Score of each test in per cent (2 places), how many of its gradable questions were not right, and which.

    ``tests`` has the columns ``by`` and ``test``, ``questions`` has ``test, question_id, prompt, expected`` (null: not
    gradable), ``answers`` has ``by, question_id, answer``. Answers match if equal once trimmed and in lower case; a missing
    one counts as empty. A test without gradable questions scores 0. ``skill_gaps`` maps questions to their prompts.
    """
    key = [*by, *(t for t in test if t not in by)]
    plain = lambda c: F.lower(F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" \t\n\r\f\v")))
    gradable = questions.filter(F.col("expected").isNotNull())
    asked = tests.select(*key).distinct().join(gradable, test, "left")
    given = answers.groupBy(*by, "question_id").agg(F.max("answer").alias("answer"))
    right = F.col("question_id").isNotNull() & (plain("answer") == plain("expected"))
    missed = F.col("question_id").isNotNull() & ~right
    rows = asked.join(given, [*by, "question_id"], "left")
    return rows.groupBy(*key).agg(
        F.coalesce(F.round(F.try_divide(100 * F.count_if(right), F.count("question_id")), 2), F.lit(0.0)).alias("score"),
        F.count_if(missed).alias("wrong"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(missed, F.struct("question_id", "prompt"))))).alias("skill_gaps"),
    )


def unknown_questions(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """A11. Answers to questions that do not exist."""
    return answers.join(questions, "question_id", "left_anti")


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """A12. Evidence items by source type."""
    return evidence.groupBy("source_type").agg(F.count("*").alias("n"))


def salary_stats(jobs: DataFrame) -> DataFrame:
    """A13. Median disclosed pay and its sample for each career."""
    pay = F.when(F.coalesce("salary_disclosed", F.lit(False)), F.col("salary_mid_vnd"))
    return _with_median(jobs.select("career_id").distinct(), ["career_id"], spread_median(jobs, ["career_id"], pay))
