"""Career profiles from evidence, and ranking of careers for a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import record_hash
from marketloom.operators.aggregate import active_jobs, spread_median

# Dimensions of interest in their order.
DIMENSIONS = ["Realistic", "Investigative", "Artistic", "Social", "Enterprising", "Conventional"]
# Software that comes first, where a name holds one of these between spaces or words.
PREFERRED_TOOLS = ["sql", "python", "tableau", "power bi", "excel", " r ", "javascript", "react", "git", "amazon web services", "azure", "adobe"]
# A profile's first sentence where no occupation is described.
MARKET_OVERVIEW = "Hồ sơ thị trường của %s được tổng hợp từ %s tin tuyển dụng tại %s doanh nghiệp trong các nguồn đang theo dõi."
NO_OVERVIEW = "Chưa có đủ bằng chứng tuyển dụng hiện hành để mô tả chi tiết nghề %s."


def career_evidence(jobs: DataFrame, occupations: DataFrame, tasks: DataFrame, code_map: DataFrame) -> DataFrame:
    """C1. ``career_id, source_type, reference_id, text``: active postings with a text, and occupation references."""
    posting = active_jobs(jobs).filter("career_id is not null and trim(coalesce(description_raw, '')) <> ''")
    a = posting.select("career_id", F.lit("posting").alias("source_type"), F.col("job_id").alias("reference_id"), F.col("description_raw").alias("text"))
    lists = tasks.groupBy("onetsoc_code").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("task_id", "task"))), lambda t: t["task"]), "\n").alias("tasks"))
    occupation = code_map.join(occupations, "onetsoc_code").join(lists, "onetsoc_code", "left")
    b = occupation.select("career_id", F.lit("occupation").alias("source_type"), F.col("onetsoc_code").alias("reference_id"), F.concat_ws("\n", "description", "tasks").alias("text"))
    return a.unionByName(b)


def career_facts(matrix: DataFrame, interests: DataFrame) -> DataFrame:
    """C2. Shares of market skills and mean interest scores as one table of facts."""
    a = matrix.select("career_id", F.lit("market_skill").alias("fact_type"), F.col("skill_id").alias("name"), F.col("share_of_career_jobs").alias("value"), F.col("skill_posting_count").cast("long").alias("sample_size"))
    b = interests.groupBy("career_id", "element_name").agg(F.round(F.avg("data_value"), 3).alias("value"), F.count("*").alias("sample_size"))
    return a.unionByName(b.select("career_id", F.lit("interest").alias("fact_type"), F.col("element_name").alias("name"), "value", "sample_size"))


def interest_profile(interests: DataFrame, dimensions: list[str] = DIMENSIONS, top: int = 3) -> DataFrame:
    """C3. First letters of the ``top`` dimensions by mean score, ties in the fixed order."""
    means = interests.groupBy("career_id", "element_name").agg(F.avg("data_value").alias("score"))
    ord_ = F.array_position(F.array(*map(F.lit, dimensions)), F.col("element_name"))
    rank = F.row_number().over(W.partitionBy("career_id").orderBy(F.desc("score"), "ord"))
    best = means.withColumn("ord", ord_).filter("ord > 0").withColumn("rank", rank).filter(F.col("rank") <= top)
    letters = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.substring("element_name", 1, 1).alias("l")))), lambda x: x["l"])
    return best.groupBy("career_id").agg(F.array_join(letters, "").alias("interest_code"))


def rated_skills(rows: DataFrame) -> DataFrame:
    """C4. Importance and level of each skill of a code; suppressed and irrelevant ratings go."""
    good = rows.filter(~F.coalesce(F.col("recommend_suppress") == "Y", F.lit(False)) & ~F.coalesce(F.col("not_relevant") == "Y", F.lit(False)))
    pivot = good.groupBy("onetsoc_code", "element_id", "element_name").pivot("scale_id", ["IM", "LV"]).agg(F.max("data_value"))
    return pivot.withColumnsRenamed({"IM": "importance", "LV": "level"})


def software_skills(rows: DataFrame) -> DataFrame:
    """C5. Software of each code with flags."""
    return rows.select("onetsoc_code", F.col("workplace_example").alias("name"), F.coalesce(F.col("in_demand") == "Y", F.lit(False)).alias("in_demand"), F.coalesce(F.col("hot_technology") == "Y", F.lit(False)).alias("hot"))


def top_market_skills(matrix: DataFrame, top: int = 10) -> DataFrame:
    """C6. The skills of a career with most postings, each once."""
    most = matrix.groupBy("career_id", "skill_id", "skill_name").agg(F.max("skill_posting_count").alias("postings"))
    rank = F.row_number().over(W.partitionBy("career_id").orderBy(F.desc("postings"), "skill_id", "skill_name"))
    return most.withColumn("rank", rank).filter(F.col("rank") <= top)


def top_skills_with_fallback(market: DataFrame, software: DataFrame, rated: DataFrame, preferred: list[str] = PREFERRED_TOOLS, most_software: int = 6, top: int = 10) -> DataFrame:
    """C7. Market skills where there are any; else flagged software, then rated skills by importance, up to ``top``.

    ``software``: ``career_id, name, in_demand, hot``; ``rated``: ``career_id, element_name, importance``. Software in demand
    comes first, then that whose name holds a preferred one, then hot one. A name comes once, in whatever case.
    """
    known = market.select("career_id").distinct()
    padded = F.concat(F.lit(" "), F.lower("name"), F.lit(" "))
    place = F.coalesce(*(F.when(padded.contains(p), k) for k, p in enumerate(preferred)), F.lit(len(preferred)))
    order = F.struct((~F.col("in_demand")).cast("int"), place, (~F.col("hot")).cast("int"), "name")
    flagged = software.join(known, "career_id", "left_anti").filter("in_demand or hot").withColumn("o", order)
    once = flagged.groupBy("career_id", F.lower("name").alias("k")).agg(F.min_by(F.struct("name", "o"), "o").alias("m")).select("career_id", "k", "m.*")
    soft = once.withColumn("n", F.row_number().over(W.partitionBy("career_id").orderBy("o"))).filter(F.col("n") <= most_software).select("career_id", "k", "name", F.lit(1).alias("tier"), F.col("n").cast("double").alias("key"))
    # one row a name: a career's software may be rated too
    best = F.struct((-F.col("importance")).alias("key"), F.col("element_name").alias("name"))
    rate = rated.filter("importance is not null").join(known, "career_id", "left_anti").groupBy("career_id", F.lower("element_name").alias("k")).agg(F.min(best).alias("m"))
    rate = rate.join(soft, ["career_id", "k"], "left_anti").select("career_id", "k", "m.name", F.lit(2).alias("tier"), "m.key")
    both = soft.unionByName(rate).withColumn("rank", F.row_number().over(W.partitionBy("career_id").orderBy("tier", "key", "name"))).filter(F.col("rank") <= top)
    return market.select("career_id", F.col("skill_name").alias("name"), "rank", F.lit("market").alias("origin")).unionByName(
        both.select("career_id", "name", "rank", F.when(F.col("tier") == 1, "software").otherwise("rated").alias("origin"))
    )


def career_tasks(posting_tasks: DataFrame, reference_tasks: DataFrame, top: int = 10) -> DataFrame:
    """C8. Tasks from postings, then core and other reference tasks, equal ones once, up to ``top`` a career.

    ``posting_tasks``: ``career_id, ord, task``; ``reference_tasks``: ``career_id, task_id, task, task_type``. Tasks are equal
    if their letters (of any script) and digits are, in whatever case.
    """
    a = posting_tasks.select("career_id", F.lit(0).alias("tier"), F.col("ord").cast("long").alias("ord"), "task")
    b = reference_tasks.select("career_id", F.when(F.col("task_type") == "Core", 1).otherwise(2).alias("tier"), F.col("task_id").cast("long").alias("ord"), "task")
    key = F.trim(F.regexp_replace(F.lower("task"), r"[^\p{L}\p{N}_]+", " "))
    once = a.unionByName(b).groupBy("career_id", key.alias("k")).agg(F.min(F.struct("tier", "ord", "task")).alias("m")).select("career_id", "m.*")
    rank = F.row_number().over(W.partitionBy("career_id").orderBy("tier", "ord", "task"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= top).select("career_id", "rank", "task", F.when(F.col("tier") == 0, "posting").otherwise("occupation").alias("origin"))


def overlay_translation(tasks: DataFrame, translations: DataFrame) -> DataFrame:
    """C9. ``text_vi`` of each task by career and rank, else the task itself."""
    return tasks.join(translations.select("career_id", "rank", "text_vi"), ["career_id", "rank"], "left").withColumn("text_vi", F.coalesce("text_vi", "task"))


def market_breakdown(demand: DataFrame, top: int = 20) -> DataFrame:
    """C10. The ``top`` demand rows of a career as an array, with its places and modes in order."""
    order = W.partitionBy("career_id").orderBy(F.desc("posting_count"), F.col("province").asc_nulls_last(), "work_mode", "snapshot_version")
    ranked = demand.withColumn("rank", F.row_number().over(order))
    fields = ["rank", "province", "work_mode", "posting_count", "unique_company_count", "salary_median_vnd", "salary_sample_size", "snapshot_version"]
    row = F.when(F.col("rank") <= top, F.struct(*fields))
    return ranked.groupBy("career_id").agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_set("province")).alias("provinces"), F.array_sort(F.collect_set("work_mode")).alias("work_modes")
    )


def career_profiles(careers: DataFrame, evidence: DataFrame, demand: DataFrame, version: str) -> DataFrame:
    """C11. One row for each career of the taxonomy, those without evidence too."""
    counts = evidence.groupBy("career_id").agg(F.count_if(F.col("source_type") == "posting").alias("postings"), F.count_if(F.col("source_type") == "occupation").alias("references"), F.min_by("text", F.struct(F.when(F.col("source_type") == "occupation", 0).otherwise(1), "reference_id")).alias("overview"))
    market = demand.groupBy("career_id").agg(F.sum("posting_count").alias("market_postings"))
    joined = careers.join(counts, "career_id", "left").join(market, "career_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(F.coalesce("postings", F.lit(0)) + F.coalesce("references", F.lit(0)) > 0, "available").otherwise("insufficient_evidence")
    return joined.select("career_id", "career_name", zero("postings"), zero("references"), zero("market_postings"), "overview", status.alias("status"), F.lit(version).alias("profile_version"))


def whole_profiles(careers: DataFrame, jobs: DataFrame, demand: DataFrame, skills: DataFrame, tasks: DataFrame, interests: DataFrame, occupations: DataFrame, evidence: DataFrame, taxonomy_version: str, day: str) -> DataFrame:
    """C11. The whole profile of every career of the taxonomy, with its parts as nested columns.

    ``careers``: ``career_id, career_name, aliases``; ``demand`` as of A1; ``skills``: ``career_id, rank, name, origin`` (C7);
    ``tasks``: ``career_id, rank, task, origin`` (C8), perhaps with ``text_vi`` (C9); ``interests``: ``career_id, element_name,
    data_value``; ``occupations``: ``career_id, onetsoc_code, description``; ``evidence`` as of C1. Postings count once by id.
    A career without evidence has counts of 0, empty arrays and status ``insufficient_evidence``.
    """
    mine = active_jobs(jobs).filter("career_id is not null")
    pay = F.when(F.coalesce("salary_disclosed", F.lit(False)), F.col("salary_mid_vnd"))
    counted = mine.groupBy("career_id").agg(
        F.count_distinct("job_id").alias("posting_count"),
        F.count_distinct("company_name").alias("company_count"),
        F.array_sort(F.collect_set("work_mode")).alias("work_modes"),
        F.array_sort(F.collect_set("province")).alias("provinces"),
    )
    # careers without pay are filled below
    paid = spread_median(mine, ["career_id"], pay).select(F.col("_k0").alias("career_id"), F.col("median").alias("salary_median_vnd"), F.col("n").alias("salary_sample_size"))
    top = skills.groupBy("career_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "origin"))).alias("top_skills"))
    said = F.struct("rank", "task", "origin", *(["text_vi"] if "text_vi" in tasks.columns else []))
    typical = tasks.groupBy("career_id").agg(F.sort_array(F.collect_list(said)).alias("typical_tasks"))
    means = interests.filter(F.col("element_name").isin(DIMENSIONS)).groupBy("career_id", "element_name").agg(F.round(F.avg("data_value"), 3).alias("v"))
    place = F.array_position(F.array(*map(F.lit, DIMENSIONS)), F.col("element_name"))
    by_place = F.sort_array(F.collect_list(F.struct(place.alias("k"), F.substring("element_name", 1, 1).alias("letter"), "v")))
    scores = means.groupBy("career_id").agg(F.map_from_entries(F.transform(by_place, lambda x: F.struct(x["letter"], x["v"]))).alias("riasec_scores"))
    described = occupations.groupBy("career_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("onetsoc_code", "description"))), lambda x: x["description"]), " ").alias("_described"))
    proof = evidence.groupBy("career_id").agg(F.count("*").alias("evidence_count"))
    joined = careers.select("career_id", F.col("career_name").alias("title"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    for part in (counted, paid, market_breakdown(demand).select("career_id", F.col("rows").alias("market_breakdown")), top, typical, scores, interest_profile(interests), described, proof):
        joined = joined.join(part, "career_id", "left")
    none = {c: F.coalesce(c, F.lit(0)) for c in ("posting_count", "company_count", "salary_sample_size", "evidence_count")}
    none |= {c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("work_modes", "provinces", "market_breakdown", "top_skills", "typical_tasks")}
    filled = joined.withColumns(none)
    market = F.format_string(MARKET_OVERVIEW, "title", F.col("posting_count").cast("string"), F.col("company_count").cast("string"))
    overview = F.when(F.coalesce("_described", F.lit("")) != "", F.col("_described")).when(F.col("posting_count") > 0, market).otherwise(F.format_string(NO_OVERVIEW, "title"))
    return filled.select(
        "career_id", "title", "aliases", overview.alias("overview"), "top_skills", "work_modes", "provinces", "market_breakdown", "typical_tasks", "posting_count", "company_count",
        "riasec_scores", F.coalesce("interest_code", F.lit("")).alias("riasec_code"), "salary_median_vnd", "salary_sample_size", "evidence_count",
        F.when(F.col("evidence_count") > 0, "available").otherwise("insufficient_evidence").alias("detail_status"),
        F.lit(f"{taxonomy_version}:{day}").alias("profile_version"), F.lit(taxonomy_version).alias("taxonomy_version"),
    )


def changed_rows(current: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """C12. Rows whose record differs from the cached hash, and the cached rows that can be used again."""
    hashed = current.withColumn("record_hash", record_hash(current.columns))
    old = cache.select(key, F.col("record_hash").alias("_old"))
    joined = hashed.join(old, key, "left")
    same = F.col("record_hash").eqNullSafe(F.col("_old"))
    return joined.filter(~same).drop("_old"), joined.filter(same).drop("_old")


def rank_careers(profile_skills: DataFrame, matrix: DataFrame) -> DataFrame:
    """R1. Careers of each profile by the number of its skills that they ask for, ties by career id."""
    asked = matrix.select("career_id", "skill_id").distinct()
    counts = profile_skills.select("profile_id", "skill_id").distinct().join(asked, "skill_id").groupBy("profile_id", "career_id").agg(F.count("*").alias("matched"))
    rank = F.row_number().over(W.partitionBy("profile_id").orderBy(F.desc("matched"), "career_id"))
    return counts.withColumn("rank", rank)


def best_career(profile_skills: DataFrame, matrix: DataFrame) -> DataFrame:
    """R1. The first career of each profile only: no ranking of all of them."""
    asked = matrix.select("career_id", "skill_id").distinct()
    counts = profile_skills.select("profile_id", "skill_id").distinct().join(asked, "skill_id").groupBy("profile_id", "career_id").agg(F.count("*").alias("matched"))
    best = counts.groupBy("profile_id").agg(F.min(F.struct((-F.col("matched")).alias("m"), "career_id")).alias("b"))
    return best.select("profile_id", F.col("b.career_id").alias("career_id"), (-F.col("b.m")).alias("matched"))


def sample_jobs(best: DataFrame, jobs: DataFrame, n: int = 3) -> DataFrame:
    """R1. The first active jobs of each profile's best career."""
    rank = F.row_number().over(W.partitionBy("career_id").orderBy("job_id"))
    few = active_jobs(jobs).select("career_id", "job_id").withColumn("job_rank", rank).filter(F.col("job_rank") <= n)
    first = best.filter("rank = 1") if "rank" in best.columns else best
    return first.join(few, "career_id")


def career_handoff(profile_skills: DataFrame, matrix: DataFrame, demand: DataFrame, jobs: DataFrame, n: int = 3) -> DataFrame:
    """R1. Each profile's best career with what its market says.

    ``profile_id, career_id, matched_skill_ids`` (in order), ``market_posting_count`` and ``snapshot_version`` of its demand
    rows (null where these are of several snapshots), and ``sample_job_ids``, its first ``n`` active jobs. Profiles that no
    career asks for are left out.
    """
    best = best_career(profile_skills, matrix).select("profile_id", "career_id")
    asked = matrix.select("career_id", "skill_id").distinct()
    skills = profile_skills.select("profile_id", "skill_id").distinct().join(best, "profile_id").join(asked, ["career_id", "skill_id"])
    matched = skills.groupBy("profile_id", "career_id").agg(F.sort_array(F.collect_list("skill_id")).alias("matched_skill_ids"))
    market = demand.groupBy("career_id").agg(
        F.sum("posting_count").alias("market_posting_count"), F.when(F.min("snapshot_version") == F.max("snapshot_version"), F.min("snapshot_version")).alias("snapshot_version")
    )
    rank = F.row_number().over(W.partitionBy("career_id").orderBy("job_id"))
    few = active_jobs(jobs).select("career_id", "job_id").withColumn("_n", rank).filter(F.col("_n") <= n)
    samples = few.groupBy("career_id").agg(F.sort_array(F.collect_list("job_id")).alias("sample_job_ids"))
    return matched.join(market, "career_id", "left").join(samples, "career_id", "left").select("profile_id", "career_id", "matched_skill_ids", "market_posting_count", "sample_job_ids", "snapshot_version")
