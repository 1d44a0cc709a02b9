"""Learner evidence: abilities, gaps, plans and outcomes, for all students at once.

Every operator groups or joins by ``student_id``; catalogues of thresholds and activities are small tables of the
caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import stable_id

# Weights of sources, values of observations, and the policy's numbers.
SOURCE_WEIGHTS = {"assessment": 1.0, "academic_record": 0.9, "teacher_observation": 0.8, "activity_result": 0.7, "self_report": 0.4}
OBSERVATION_VALUES = {
    ("strength", "low"): 0.65, ("strength", "medium"): 0.80, ("strength", "high"): 0.95,
    ("neutral", "low"): 0.50, ("neutral", "medium"): 0.50, ("neutral", "high"): 0.50,
    ("weakness", "low"): 0.40, ("weakness", "medium"): 0.25, ("weakness", "high"): 0.10,
}
MINIMUM_EVIDENCE, CONFLICT, LOW_CONFIDENCE = 2, 0.35, 0.55
SELF_REPORT_FACTOR, ONE_SOURCE_FACTOR = 0.60, 0.85
TREND = 0.05
HIGH, MEDIUM = 0.25, 0.10
SCHOOL, EXAM, FEASIBLE, INFEASIBLE = 1.20, 1.40, 1.0, 0.75
REGRESSION, PARTIAL, MEANINGFUL = -0.05, 0.05, 0.20
LEAST_RUBRIC = 0.60


def lookup(values: dict, *keys: Column) -> Column:
    """A value by key from a small fixed table; null if it is not there."""
    found = F.lit(None).cast("double")
    for key, value in values.items():
        key = key if isinstance(key, tuple) else (key,)
        hit = F.lit(True)
        for k, c in zip(key, keys, strict=True):
            hit = hit & (c == k)
        found = F.when(hit, F.lit(value)).otherwise(found)
    return found


def _evidence(df: DataFrame, source: str, ref: str, skill: Column, value: Column, confidence: Column, at: str) -> DataFrame:
    return df.select(
        "student_id",
        stable_id("EV", F.lit(source), F.col(ref), skill).alias("evidence_id"),
        F.lit(source).alias("source_type"),
        skill.alias("skill_id"),
        value.cast("double").alias("normalized_value"),
        confidence.cast("double").alias("confidence"),
        F.col(at).alias("observed_at"),
    )


def evidence_academic(records: DataFrame) -> DataFrame:
    """E1. ``record_id, student_id, topic_id, score, max_score, observed_at``: score over its maximum."""
    return _evidence(records, "academic_record", "record_id", F.col("topic_id"), F.try_divide("score", "max_score"), F.lit(1.0), "observed_at")


def evidence_observation(observations: DataFrame) -> DataFrame:
    """E2. Value by type and severity."""
    value = lookup(OBSERVATION_VALUES, F.col("observation_type"), F.col("severity"))
    return _evidence(observations, "teacher_observation", "observation_id", F.col("skill_id"), value, F.col("confidence"), "observed_at")


def evidence_assessment(attempts: DataFrame) -> DataFrame:
    """E3. One item for each skill of an attempt."""
    flat = attempts.select("student_id", "attempt_id", "completed_at", F.inline("skill_scores"))
    return _evidence(flat, "assessment", "attempt_id", F.col("skill_id"), F.try_divide("score", "max_score"), F.lit(1.0), "completed_at")


def evidence_self_report(reports: DataFrame) -> DataFrame:
    """E4. Interests as ``INTEREST_`` items."""
    flat = reports.select("student_id", "report_id", "observed_at", F.inline("career_interests"))
    skill = F.concat(F.lit("INTEREST_"), F.col("career_group_id"))
    return _evidence(flat, "self_report", "report_id", skill, F.try_divide("interest_score", "max_score"), F.lit(1.0), "observed_at")


def evidence_activity(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """E5. Completed activities with a rubric score, on the catalogue's skill. Unknown activities raise an error."""
    known = results.join(catalog.select("activity_id", "rubric_skill_id", F.lit(True).alias("_k")), "activity_id", "left")
    checked = known.filter(F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("unknown activity: "), "activity_id")).cast("boolean")).otherwise(True))
    done = checked.filter("completed and rubric_score is not null and rubric_skill_id is not null")
    return _evidence(done, "activity_result", "activity_result_id", F.col("rubric_skill_id"), F.try_divide("rubric_score", "max_score"), F.lit(1.0), "completed_at")


def merge_evidence(*parts: DataFrame, strict: bool = True) -> DataFrame:
    """E6. All items, equal ones once. With ``strict``, an id that stands for different items is an error when read."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if not strict:
        return every.distinct()
    item = F.struct(*[c for c in every.columns if c != "evidence_id"])
    once = every.groupBy("evidence_id").agg(F.min(item).alias("m"), F.max(item).alias("_last"))
    same = F.when(F.col("m").eqNullSafe(F.col("_last")), True).otherwise(F.raise_error(F.concat(F.lit("conflicting evidence: "), "evidence_id")).cast("boolean"))
    return once.filter(same).select("evidence_id", "m.*").select(*every.columns)


def conflicting_evidence(evidence: DataFrame) -> DataFrame:
    """E6. Ids that stand for different items."""
    return evidence.distinct().groupBy("evidence_id").agg(F.count("*").alias("n")).filter("n > 1")


def ability_profile(evidence: DataFrame, with_ids: bool = False) -> DataFrame:
    """E7. Level and confidence of each student's skills, from weighted evidence; interests are left out.

    ``with_ids`` adds ``evidence_ids``, the ids of what an estimate rests on, in order: one learner's items of one skill.
    """
    rows = evidence.filter(~F.col("skill_id").startswith("INTEREST_")).withColumn("w", lookup(SOURCE_WEIGHTS, F.col("source_type")) * F.col("confidence"))
    v = F.col("normalized_value")
    sums = rows.groupBy("student_id", "skill_id").agg(
        F.sum(v * F.col("w")).alias("vw"), F.sum("w").alias("w"), F.count("*").alias("n"), F.min("source_type").alias("a"), F.max("source_type").alias("b"), (F.max(v) - F.min(v)).alias("spread"),
        *([F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids")] if with_ids else []),
    )
    one = F.when((F.col("n") == 1) & (F.col("a") == "self_report"), SELF_REPORT_FACTOR).when((F.col("n") > 1) & (F.col("a") == F.col("b")), ONE_SOURCE_FACTOR).otherwise(1.0)
    agree = F.when(F.col("spread") > CONFLICT, F.greatest(F.lit(0.25), 1 - (F.col("spread") - CONFLICT) / (1 - CONFLICT))).otherwise(1.0)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w") / MINIMUM_EVIDENCE) * one * agree))
    return sums.select("student_id", "skill_id", F.round(F.try_divide("vw", "w"), 6).alias("estimated_level"), F.round(sure, 6).alias("confidence"), F.col("n").alias("evidence_count"), *(["evidence_ids"] if with_ids else []))


def ability_trend(current: DataFrame, previous: DataFrame) -> DataFrame:
    """E8. Change against the estimate before: improving, stable, declining or unknown."""
    old = previous.select("student_id", "skill_id", F.col("estimated_level").alias("_old"))
    delta = F.col("estimated_level") - F.col("_old")
    trend = F.when(delta.isNull(), "unknown").when(delta >= TREND, "improving").when(delta <= -TREND, "declining").otherwise("stable")
    return current.join(old, ["student_id", "skill_id"], "left").withColumn("trend", trend).drop("_old")


def priority_score(gap_size, confidence, importance, exam_week, feasible) -> Column:
    """E10."""
    return F.round(gap_size * confidence * importance * F.when(exam_week, EXAM).otherwise(SCHOOL) * F.when(feasible, FEASIBLE).otherwise(INFEASIBLE), 6)


def academic_gaps(ability: DataFrame, students: DataFrame, thresholds: DataFrame) -> DataFrame:
    """E9, E10. Skills below their threshold, with size and priority; low confidence caps it at medium.

    ``thresholds``: ``skill_id, expected_level, importance, activity_minutes`` (null: no activity), a small table.
    ``students``: ``student_id, weekly_available_minutes, exam_week``. If estimates carry ``evidence_ids``, so do gaps, with a
    ``reason`` that names them.
    """
    below = ability.join(thresholds, "skill_id").filter(F.col("estimated_level") < F.col("expected_level")).join(students, "student_id")
    size = F.round(F.col("expected_level") - F.col("estimated_level"), 6)
    feasible = F.coalesce(F.col("activity_minutes") <= F.col("weekly_available_minutes"), F.lit(False))
    scored = below.withColumns({"gap_size": size, "feasible": feasible}).withColumn("score", priority_score(F.col("gap_size"), F.col("confidence"), F.coalesce("importance", F.lit(1.0)), F.coalesce("exam_week", F.lit(False)), F.col("feasible")))
    band = F.when((F.col("score") >= HIGH) & (F.col("confidence") >= LOW_CONFIDENCE), "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    # fixed value: the sentence that says what a gap rests on
    reason = F.concat(F.lit("Mức hiện tại dưới ngưỡng; dựa trên evidence: "), F.array_join("evidence_ids", ", "), F.lit("."))
    proof = ["evidence_ids", reason.alias("reason")] if "evidence_ids" in ability.columns else []
    return scored.select("student_id", stable_id("GAP", F.lit("academic"), "skill_id").alias("gap_id"), "skill_id", "estimated_level", "expected_level", "gap_size", "score", band.alias("priority"), *proof)


def completed_groups(results: DataFrame) -> DataFrame:
    """Career groups that a student has explored well enough."""
    good = F.coalesce(F.col("completed") & (F.try_divide("rubric_score", "max_score") >= LEAST_RUBRIC), F.lit(False))
    return results.filter(good).select("student_id", "career_group_id").distinct()


def _interests(students: DataFrame) -> DataFrame:
    return students.select("student_id", "weekly_available_minutes", F.posexplode("career_interest_ids").alias("pos", "career_group_id"))


def exploration_gaps(students: DataFrame, results: DataFrame, catalog: DataFrame) -> DataFrame:
    """E11. Declared interests not explored yet; high if an activity of the group fits the week.

    ``catalog``: ``career_group_id, activity_id, estimated_minutes``, one activity a group.
    """
    open_ = _interests(students).join(completed_groups(results), ["student_id", "career_group_id"], "left_anti")
    fits = F.coalesce(F.col("estimated_minutes") <= F.col("weekly_available_minutes"), F.lit(False))
    return open_.join(catalog, "career_group_id", "left").select("student_id", "career_group_id", "pos", "activity_id", F.when(fits, "high").otherwise("medium").alias("priority"))


def decision_gaps(students: DataFrame, results: DataFrame) -> DataFrame:
    """E12. Students with two interests or more that are not all explored."""
    done = completed_groups(results).withColumn("_d", F.lit(1))
    sums = _interests(students).join(done, ["student_id", "career_group_id"], "left").groupBy("student_id").agg(F.count("*").alias("interests"), F.count("_d").alias("explored"))
    return sums.filter("interests >= 2 and explored < interests")


def _open_academic(academic: DataFrame, thresholds: DataFrame, completed: DataFrame) -> DataFrame:
    """High academic gaps with an activity that the student has not completed."""
    acts = thresholds.filter("activity_id is not null").select("skill_id", "activity_id", "activity_minutes")
    return academic.filter("priority = 'high'").join(acts, "skill_id").join(completed, ["student_id", "activity_id"], "left_anti")


def _open_interests(exploration: DataFrame, completed: DataFrame) -> DataFrame:
    """Interests with an open gap and an activity that the student has not completed."""
    return exploration.filter("activity_id is not null").join(completed, ["student_id", "activity_id"], "left_anti")


def weekly_plan(students: DataFrame, academic: DataFrame, exploration: DataFrame, thresholds: DataFrame, catalog: DataFrame, completed: DataFrame) -> DataFrame:
    """E13. Up to two tasks a student: the largest high academic gap whose activity fits, then the first open interest
    if it fits the rest (not in an exam week). ``completed`` (``student_id, activity_id``) is not planned again."""
    done = completed.select("student_id", "activity_id").distinct()
    budget = students.select("student_id", "weekly_available_minutes", F.coalesce("exam_week", F.lit(False)).alias("exam_week"))
    fitting = _open_academic(academic, thresholds, done).join(budget, "student_id").filter("activity_minutes <= weekly_available_minutes")
    first = fitting.groupBy("student_id").agg(F.min_by(F.struct("activity_id", F.col("activity_minutes").alias("minutes"), "gap_id"), F.struct(-F.col("gap_size"), "gap_id")).alias("a"))
    interest = _open_interests(exploration, done).groupBy("student_id").agg(F.min_by(F.struct("activity_id", "career_group_id"), "pos").alias("i"))
    times = catalog.select(F.col("activity_id").alias("_id"), F.col("estimated_minutes").alias("_minutes"))
    both = budget.join(first, "student_id", "left").join(interest, "student_id", "left").join(times, F.col("i.activity_id") == F.col("_id"), "left")
    rest = F.col("weekly_available_minutes") - F.coalesce("a.minutes", F.lit(0))
    second = F.when(~F.col("exam_week") & (F.col("_minutes") <= rest), F.struct(F.lit(2).alias("task_no"), F.col("i.activity_id").alias("activity_id"), F.col("_minutes").alias("minutes")))
    one = F.when(F.col("a").isNotNull(), F.struct(F.lit(1).alias("task_no"), F.col("a.activity_id").alias("activity_id"), F.col("a.minutes").alias("minutes")))
    return both.select("student_id", F.inline(F.array_compact(F.array(one, second))))


def outcome_status(delta: Column) -> Column:
    return F.when(delta <= REGRESSION, "regression").when(delta < PARTIAL, "no_meaningful_change").when(delta < MEANINGFUL, "partial_improvement").otherwise("meaningful_improvement")


def assessment_outcomes(before: DataFrame, after: DataFrame) -> DataFrame:
    """E14. Change of each skill found in both attempts; both have ``pair_id, student_id, skill_id, value``."""
    a = after.select("pair_id", "student_id", "skill_id", F.col("value").alias("after"))
    joined = before.select("pair_id", "skill_id", F.col("value").alias("before")).join(a, ["pair_id", "skill_id"])
    delta = F.round(F.col("after") - F.col("before"), 10)
    return joined.withColumn("delta", delta).withColumn("status", outcome_status(F.col("delta")))


def asof_baseline(posttests: DataFrame, baselines: DataFrame, by: list[str]) -> DataFrame:
    """E15. For each posttest the latest baseline of the same keys no later than it, ties to the larger id.

    One sort by key and time over the union of both; no pair is built. Posttests without one are left out.
    """
    row = lambda df, kind, id_: df.select(*by, F.col("at"), F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col("value"))
    both = row(baselines, 0, "attempt_id").unionByName(row(posttests, 1, "attempt_id"))
    w = W.partitionBy(*by).orderBy("at", "kind", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("kind") == 0, F.struct("id", "at", "value")), ignorenulls=True).over(w)
    found = both.withColumn("b", last).filter("kind = 1 and b is not null")
    return found.select(*by, F.col("id").alias("posttest_id"), F.col("at").alias("posttest_at"), F.col("value").alias("after"), F.col("b.id").alias("baseline_id"), F.col("b.at").alias("baseline_at"), F.col("b.value").alias("before"))


def interest_outcomes(results: DataFrame) -> DataFrame:
    """E16. Interest before and after an activity, as shares of the most."""
    share = lambda c: F.try_divide(F.col(c), F.col("interest_max_score"))
    rows = results.filter("completed").select("student_id", "activity_result_id", "career_group_id", share("interest_before").alias("before"), share("interest_after").alias("after"))
    return rows.withColumn("delta", F.round(F.col("after") - F.col("before"), 10)).withColumn("status", outcome_status(F.col("delta")))


def next_step(students: DataFrame, academic: DataFrame, exploration: DataFrame, thresholds: DataFrame, completed: DataFrame) -> DataFrame:
    """E17. One step a student: the largest high academic gap with an activity not yet completed (``completed``:
    ``student_id, activity_id``), else the first open interest with one, else none."""
    done = completed.select("student_id", "activity_id").distinct()
    one = _open_academic(academic, thresholds, done).select("student_id", F.lit(1).alias("tier"), (-F.col("gap_size")).alias("by"), F.col("gap_id").alias("tie"), "activity_id")
    two = _open_interests(exploration, done).select("student_id", F.lit(2).alias("tier"), F.col("pos").cast("double").alias("by"), F.lit("").alias("tie"), "activity_id")
    best = one.unionByName(two).groupBy("student_id").agg(F.min_by(F.struct("tier", "activity_id"), F.struct("tier", "by", "tie")).alias("m"))
    kind = F.when(F.col("m.tier") == 1, "academic").when(F.col("m.tier") == 2, "exploration").otherwise("none")
    return students.select("student_id").join(best, "student_id", "left").select("student_id", kind.alias("step"), F.col("m.activity_id").alias("activity_id"))


def evidence_warnings(evidence: DataFrame) -> DataFrame:
    """E18. Warnings on each skill: too few items, a conflict, low confidence."""
    base = ability_profile(evidence)
    v = F.col("normalized_value")
    spread = evidence.filter(~F.col("skill_id").startswith("INTEREST_")).groupBy("student_id", "skill_id").agg((F.max(v) - F.min(v)).alias("spread"))
    tests = [(F.col("evidence_count") < MINIMUM_EVIDENCE, "insufficient_evidence"), (F.col("spread") > CONFLICT, "conflicting_evidence"), (F.col("confidence") < LOW_CONFIDENCE, "low_confidence_estimate")]
    codes = F.array_compact(F.array(*(F.when(t, F.lit(c)) for t, c in tests)))
    field = F.concat(F.lit("ability_profile."), "skill_id")
    return base.join(spread, ["student_id", "skill_id"]).select("student_id", F.explode(codes).alias("code"), field.alias("field")).distinct()


def initial_warnings(students: DataFrame, optional: dict[str, DataFrame], evidence: DataFrame, catalog: DataFrame, market: DataFrame, least_sample: int = 5) -> DataFrame:
    """E19. ``student_id, code, field``: optional inputs that a student lacks, fewer than two evidence items in all, the
    warnings of E18, interests that market or activity catalogue don't know, and a small market sample."""
    who = students.select("student_id")
    parts = [who.join(df.select("student_id").distinct(), "student_id", "left_anti").select("student_id", F.lit("optional_data_missing").alias("code"), F.lit(name).alias("field")) for name, df in optional.items()]
    items = who.join(evidence.groupBy("student_id").agg(F.count("*").alias("n")), "student_id", "left").filter(F.coalesce("n", F.lit(0)) < 2)
    parts.append(items.select("student_id", F.lit("insufficient_evidence").alias("code"), F.lit("ability_profile").alias("field")))
    parts.append(evidence_warnings(evidence.join(who, "student_id", "left_semi")))
    named = students.select("student_id", F.posexplode("career_interest_ids").alias("pos", "career_group_id"))
    known = market.select("career_group_id").intersect(catalog.select("career_group_id"))
    odd = named.join(known, "career_group_id", "left_anti")
    parts.append(odd.select("student_id", F.lit("unknown_career_group").alias("code"), F.concat(F.lit("student.career_interest_ids."), F.col("pos").cast("string")).alias("field")))
    small = market.agg(F.coalesce(F.bool_or(F.col("sample_size") < least_sample), F.lit(False)).alias("small")).filter("small")
    # every student beside one row at most
    parts.append(who.crossJoin(small).select("student_id", F.lit("small_market_sample").alias("code"), F.lit("market_context").alias("field")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct()


def followup_warnings(posttests: DataFrame, paired: DataFrame, skills: DataFrame, snapshots: DataFrame) -> DataFrame:
    """E20. ``student_id, code, field``: posttests without a baseline or without a common skill, and profiles of another
    version than expected.

    ``posttests``: ``student_id, attempt_id, idx`` (place in the student's list); ``paired``: ``posttest_id, baseline_id``;
    ``skills``: ``attempt_id, skill_id``; ``snapshots``: ``student_id, current_version, expected_version``.
    """
    place = F.concat(F.lit("assessment_attempts.posttest."), F.col("idx").cast("string"))
    pairs = posttests.join(paired.select(F.col("posttest_id").alias("attempt_id"), "baseline_id"), "attempt_id", "left")
    none = pairs.filter("baseline_id is null").select("student_id", F.lit("baseline_not_found").alias("code"), place.alias("field"))
    before = skills.select(F.col("attempt_id").alias("baseline_id"), "skill_id")
    shared = pairs.join(skills, "attempt_id").join(before, ["baseline_id", "skill_id"]).select("attempt_id").distinct()
    apart = pairs.filter("baseline_id is not null").join(shared, "attempt_id", "left_anti")
    apart = apart.select("student_id", F.lit("assessment_scale_mismatch").alias("code"), F.concat(place, F.lit(".skill_scores")).alias("field"))
    stale = snapshots.filter("coalesce(current_version, '') <> '' and coalesce(expected_version, '') <> '' and current_version <> expected_version")
    stale = stale.select("student_id", F.lit("stale_profile_version").alias("code"), F.lit("student.schema_version").alias("field"))
    return none.unionByName(apart).unionByName(stale).distinct()


def overlay_profile(previous: DataFrame, updated: DataFrame, outcomes: DataFrame) -> DataFrame:
    """E21. Updated estimates replace those before; an outcome overrides the trend."""
    trends = {"meaningful_improvement": "improving", "partial_improvement": "improving", "no_meaningful_change": "stable", "regression": "declining"}
    key = ["student_id", "skill_id"]
    u = updated.select(*key, F.col("estimated_level").alias("u_level"), F.col("trend").alias("u_trend"))
    o = outcomes.select(*key, "status")
    trend = F.lit(None).cast("string")
    for status, name in trends.items():
        trend = F.when(F.col("status") == status, F.lit(name)).otherwise(trend)
    joined = previous.select(*key, "estimated_level", "trend").join(u, key, "full_outer").join(o, key, "left")
    return joined.select(*key, F.coalesce("u_level", "estimated_level").alias("estimated_level"), F.coalesce(trend, "u_trend", "trend").alias("trend"))


def snapshot(ability: DataFrame, previous: DataFrame, version: str) -> DataFrame:
    """E22. One row a student: its estimates as an array, an id, and the id of the snapshot before."""
    rows = ability.groupBy("student_id").agg(F.sort_array(F.collect_list(F.struct("skill_id", "estimated_level", "confidence"))).alias("abilities"))
    made = rows.withColumn("snapshot_id", stable_id("SNAP", "student_id", F.lit(version), F.to_json("abilities")))
    before = previous.select("student_id", F.col("snapshot_id").alias("previous_snapshot_id"))
    return made.join(before, "student_id", "left").withColumn("previous_snapshot_id", F.when(F.col("previous_snapshot_id") != F.col("snapshot_id"), F.col("previous_snapshot_id")))


def map_observations(observations: DataFrame) -> DataFrame:
    """E23. Observations that name several skills, one row a skill."""
    flat = observations.select("*", F.posexplode("skill_ids").alias("skill_pos", "skill_id")).drop("skill_ids")
    return flat.withColumn("observation_id", F.concat_ws("_", "observation_id", "skill_pos"))


def map_interests(tokens: Column, groups: dict[str, str], default: str) -> Column:
    """E23. Career groups that free interest tokens name, in order and once; the default if none does."""
    def group(t: Column) -> Column:
        found = F.lit(None).cast("string")
        for word, name in reversed(groups.items()):
            found = F.when(F.lower(t).contains(word), F.lit(name)).otherwise(found)
        return found

    found = F.array_distinct(F.array_compact(F.transform(tokens, group)))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit(default)))
