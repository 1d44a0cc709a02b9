"""Data-quality assertions: each gives the violations as ``rule, key, detail``; no row means the rule holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from marketloom.operators.aggregate import DEMAND_KEYS, demand_summary


def violation(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _key(columns: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns))


def required_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """V1. One row for each missing column."""
    missing = sorted(set(columns) - set(df.columns))
    rows = df.sparkSession.createDataFrame([(c,) for c in missing], "c string")
    return violation(rows, "required_column", F.col("c"), F.lit("missing"))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """V2. Keys found more than once."""
    twice = df.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
    return violation(twice, f"unique:{','.join(columns)}", _key(columns), F.col("_n"))


def not_blank(df: DataFrame, column: str, key: str) -> DataFrame:
    """V3. Null or blank values."""
    return violation(df.filter(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""), f"not_blank:{column}", F.col(key), F.lit("null or blank"))


def in_range(df: DataFrame, column: str, key: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """V4. Values outside the range; nulls pass."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return violation(df.filter(bad), f"range:{column}", F.col(key), F.col(column))


def in_domain(df: DataFrame, column: str, key: str, values: list[str]) -> DataFrame:
    """V4. Values not in the domain; nulls pass."""
    return violation(df.filter(~F.col(column).isin(values)), f"domain:{column}", F.col(key), F.col(column))


def ordered(df: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """V4. Rows whose ``first`` is beyond their ``second``: dates, seen times, samples against postings."""
    return violation(df.filter(F.col(first) > F.col(second)), f"ordered:{first}<={second}", F.col(key), F.concat_ws(">", first, second))


def references(df: DataFrame, column: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """V5. Values without a parent; nulls pass."""
    known = parents.select(F.col(parent_key).alias(column)).distinct()
    orphans = df.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
    return violation(orphans, f"references:{column}", F.col(key), F.col(column))


def reconciled(jobs: DataFrame, summary: DataFrame, tolerance: float = 0.01, seq_col: str | None = None, keys: list[str] = DEMAND_KEYS) -> DataFrame:
    """V6. Groups whose sample or median differs from one computed anew; null keys match each other."""
    again = demand_summary(jobs, seq_col, keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("salary_sample_size").alias("_n"), F.col("salary_median_vnd").alias("_m"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = summary.join(again, same, "full_outer")
    close = (F.col("salary_sample_size") == F.col("_n")) & ((F.col("salary_median_vnd").isNull() & F.col("_m").isNull()) | (F.abs(F.col("salary_median_vnd") - F.col("_m")) <= tolerance))
    key = F.concat_ws("|", *(F.coalesce(F.col(k), F.col(f"_{k}")).cast("string") for k in keys))
    return violation(both.filter(~F.coalesce(close, F.lit(False))), "reconciled:demand", key, F.concat_ws("/", "salary_sample_size", "_n"))


def one_version(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """V7. Versions besides the only one that all tables should share."""
    every = None
    for name, df in tables.items():
        part = df.select(F.col(column).alias("v")).distinct().select(F.lit(name).alias("t"), "v")
        every = part if every is None else every.unionByName(part)
    count = every.agg(F.count_distinct("v").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"))
    # a handful of rows beside one row
    return violation(every.crossJoin(count).filter("n <> 1 or nulls > 0"), f"one_version:{column}", F.col("t"), F.col("v"))


def taxonomy_structure(entities: DataFrame, prefix: str) -> DataFrame:
    """V8. Ids not unique or without their prefix, blank names, empty or repeated aliases (``id, name, aliases``)."""
    bad_id = violation(entities.filter(~F.coalesce(F.col("id").startswith(prefix), F.lit(False))), "taxonomy:prefix", F.col("id"), F.lit(prefix))
    empty = violation(entities.filter(F.coalesce(F.size("aliases"), F.lit(0)) < 1), "taxonomy:no_alias", F.col("id"), F.lit("no alias"))
    flat = entities.select("id", F.explode("aliases").alias("a"))
    blank = violation(flat.filter(F.trim(F.coalesce("a", F.lit(""))) == ""), "taxonomy:blank_alias", F.col("id"), F.lit("blank"))
    twice = flat.groupBy("id", F.lower(F.trim("a")).alias("a")).agg(F.count("*").alias("n")).filter("n > 1")
    repeated = violation(twice, "taxonomy:repeated_alias", F.col("id"), F.col("a"))
    return unique(entities, ["id"]).unionByName(bad_id).unionByName(not_blank(entities, "name", "id")).unionByName(empty).unionByName(blank).unionByName(repeated)


def learner_profile(profiles: DataFrame, skills: DataFrame, locations: DataFrame, modes: list[str]) -> DataFrame:
    """V9. Unknown skills and provinces, invalid modes (``id, skill_ids, provinces, mode``; dims hold ``id`` and ``alias``)."""
    s = profiles.select("id", F.explode("skill_ids").alias("x")).join(skills.select(F.col("id").alias("x")), "x", "left_anti")
    p = profiles.select("id", F.explode("provinces").alias("x")).withColumn("alias", F.lower(F.trim("x"))).join(locations.select("alias"), "alias", "left_anti")
    return violation(s, "profile:skill", F.col("id"), F.col("x")).unionByName(violation(p, "profile:province", F.col("id"), F.col("x"))).unionByName(in_domain(profiles, "mode", "id", modes))


def valid_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """V10. Answers that do not suit their question's type.

    ``answers``: ``answer_id, question_id, value`` (text) and ``items`` (array of text; allocations as ``option=points``).
    ``questions``: ``question_id, type, options, low, high, max_words``.
    """
    a = answers.join(questions, "question_id")
    inside = lambda xs: F.size(F.array_except(xs, "options")) == 0
    number = F.expr("try_cast(value as double)")
    points = F.transform("items", lambda x: F.nullif(F.regexp_extract(x, r"=(-?[0-9]+(?:\.[0-9]+)?)$", 1), F.lit("")).cast("double"))
    total = F.aggregate(points, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(-1e9)))
    each = F.size(F.array_distinct("items")) == F.size("items")
    good = (
        F.when(F.col("type") == "choice", F.array_contains("options", F.col("value")))
        .when(F.col("type") == "multi_choice", inside(F.col("items")) & each)
        .when(F.col("type").isin("number", "likert"), number.isNotNull() & number.between(F.col("low"), F.col("high")))
        .when(F.col("type") == "ranking", inside(F.col("items")) & each & (F.size("items") == F.size("options")))
        .when(F.col("type") == "allocation", (F.abs(total - 100) <= 0.001) & F.forall(points, lambda x: x >= 0))
        .when(F.col("type") == "trade_off", number.isNotNull() & number.between(F.col("low"), F.col("high")))
        .when(F.col("type") == "text", (F.size(F.split(F.trim("value"), r"\s+")) <= F.col("max_words")) & (F.length("value") <= F.col("high")))
    )
    return violation(a.filter(~F.coalesce(good, F.lit(False))), "answer", F.col("answer_id"), F.col("type"))


def visible(conditions: DataFrame, answers: DataFrame) -> DataFrame:
    """F6. ``submission_id, question_id, is_visible``: all of a question's conditions on other answers hold.

    ``conditions``: ``question_id, depends_on, operator, operand`` (``equals``, ``not_equals``, ``in`` with values
    joined by ``|``); ``answers``: ``submission_id, question_id, value``. An unanswered question
    meets no condition.
    """
    who = answers.select("submission_id").distinct()
    value = answers.select("submission_id", F.col("question_id").alias("depends_on"), "value")
    asked = who.crossJoin(conditions)  # conditions are a questionnaire's, some dozens
    joined = asked.join(value, ["submission_id", "depends_on"], "left")
    holds = (
        F.when(F.col("operator") == "equals", F.col("value") == F.col("operand"))
        .when(F.col("operator") == "not_equals", (F.coalesce("value", F.lit("")) != "") & (F.col("value") != F.col("operand")))
        .when(F.col("operator") == "in", F.array_contains(F.split("operand", r"\|"), F.col("value")))
    )
    return joined.groupBy("submission_id", "question_id").agg(F.min(F.coalesce(holds, F.lit(False))).alias("is_visible"))


def visible_chained(conditions: DataFrame, answers: DataFrame) -> DataFrame:
    """F6. As ``visible``, but an answer to a hidden question counts as none, so that hidden questions hide others.

    A question is visible if its own conditions hold and those of all questions that it depends on, directly or not. The
    graph is that of the questionnaire, whose conditions are some dozens. Questions that depend on one another in a circle
    are visible if all their conditions hold.
    """
    above = conditions.select("question_id", F.col("depends_on").alias("by")).distinct()
    closure, known = above, -1
    while (n := closure.count()) > known:
        known = n
        further = closure.join(above.select(F.col("question_id").alias("by"), F.col("by").alias("next")), "by").select("question_id", F.col("next").alias("by"))
        closure = closure.unionByName(further).distinct()
    whole = closure.unionByName(conditions.select("question_id", F.col("question_id").alias("by"))).distinct()
    own = visible(conditions, answers).withColumnRenamed("question_id", "by")
    return own.join(whole, "by").groupBy("submission_id", "question_id").agg(F.min("is_visible").alias("is_visible"))


def submission(answers: DataFrame, questions: DataFrame, visibility: DataFrame) -> DataFrame:
    """V11. Answers to unknown questions, answers to hidden ones, and required visible ones without an answer."""
    key = F.concat_ws("/", "submission_id", "question_id")
    unknown = answers.join(questions, "question_id", "left_anti")
    hidden = answers.join(visibility.filter(~F.col("is_visible")), ["submission_id", "question_id"], "left_semi")
    needed = answers.select("submission_id").distinct().crossJoin(questions.filter("required").select("question_id"))  # a questionnaire's, some dozens
    shown = needed.join(visibility, ["submission_id", "question_id"], "left").filter(F.coalesce("is_visible", F.lit(True)))
    missing = shown.join(answers.filter(F.coalesce("value", F.lit("")) != ""), ["submission_id", "question_id"], "left_anti")
    return violation(unknown, "submission:unknown", key, F.lit("unknown question")).unionByName(violation(hidden, "submission:hidden", key, F.lit("answered but hidden"))).unionByName(
        violation(missing, "submission:missing", key, F.lit("required"))
    )


def report_reconciled(report: DataFrame, total: str, parts: list[str], rates: list[str], key: str) -> DataFrame:
    """V12. Rates outside 0 to 1, and totals that are not the sum of their parts."""
    out = violation(report.filter(F.col(total) != sum((F.col(p) for p in parts[1:]), F.col(parts[0]))), f"total:{total}", F.col(key), F.col(total))
    for r in rates:
        out = out.unionByName(in_range(report, r, key, 0.0, 1.0))
    return out


def report_differences(left: DataFrame, right: DataFrame, fields: dict[str, str]) -> DataFrame:
    """V12. Where two reports of one row each differ: ``rule, key, detail``, the values as ``left/right``.

    ``fields`` maps columns of ``left`` to those of ``right``. Maps are compared entry by entry (``key`` is then the entry's);
    null equals null, numbers are equal up to 1e-9. A report without its row differs in every field.
    """
    pairs = [(F.col(f"l.{a}").alias(f"_l{i}"), F.col(f"r.{b}").alias(f"_r{i}")) for i, (a, b) in enumerate(fields.items())]
    one = left.limit(1).withColumn("_one", F.lit(1)).alias("l")
    both = one.join(right.limit(1).withColumn("_one", F.lit(1)).alias("r"), "_one", "full_outer").select(*(c for pair in pairs for c in pair))  # one row beside one row
    number = lambda kind: re.match("int|bigint|double|float|decimal", kind)

    def difference(name: str, key: Column, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
        close = F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= 1e-9, F.lit(False))
        same = a.eqNullSafe(b) | close if all(map(number, kinds)) else a.cast("string").eqNullSafe(b.cast("string"))
        shown = F.concat_ws("/", *(F.coalesce(c.cast("string"), F.lit("null")) for c in (a, b)))
        return F.when(~same, F.struct(F.lit(f"differs:{name}").alias("rule"), key.cast("string").alias("key"), shown.alias("detail")))

    def differences(i: int, name: str) -> Column:
        a, b = F.col(f"_l{i}"), F.col(f"_r{i}")
        kinds = tuple(both.schema[c].dataType for c in (f"_l{i}", f"_r{i}"))
        if not isinstance(kinds[0], MapType):
            return F.array(difference(name, F.lit(""), a, b, tuple(k.simpleString() for k in kinds)))
        keys = F.array_union(*(F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in (a, b)))
        values = tuple(k.valueType.simpleString() for k in kinds)
        return F.transform(keys, lambda k: difference(name, k, F.try_element_at(a, k), F.try_element_at(b, k), values))

    # all fields from one row: a union of them would work the reports out once a field
    every = F.flatten(F.array(*(differences(i, name) for i, name in enumerate(fields))))
    return both.select(F.inline(F.filter(every, lambda x: x.isNotNull())))


# What generated text must not say.
UNSAFE = [
    "không phù hợp với nghề", "em quá kém", "em kém", "vô dụng", "chắc chắn sẽ thành công", "chắc chắn trở thành",
    "chắc chắn phù hợp với nghề", "nên chọn nghề", "phải chọn nghề", "chẩn đoán", "tự làm hại", "mật khẩu", "số căn cước",
    "chain of thought",
]
ENGINE_FIELDS = ["confidence", "gap priority", "outcome status", "max_score", "điểm số", "chấm điểm", "điểm tối đa"]
POLICY = {
    "technical_id": r"(?iU)\b(?:EVIDENCE|SKILL|CAREER_GROUP)_[A-Za-z0-9_-]+\b",
    "unsafe": "(?iu)" + "|".join(UNSAFE),
    "engine_field": "(?iu)" + "|".join(ENGINE_FIELDS),
    "score_promise": r"(?iU)\b\d+(?:[.,]\d+)?\s*điểm\b",
}


def text_policy(df: DataFrame, key: Column, text: str, patterns: dict[str, str] = POLICY) -> DataFrame:
    """V13. One row for each text and pattern found in it."""
    codes = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns.items())))
    return violation(df.select(key.alias("_k"), F.explode(codes).alias("_c")), "text_policy", F.col("_k"), F.col("_c"))


def package_invariants(packages: DataFrame, items: DataFrame, used: DataFrame) -> DataFrame:
    """V14. Packages of questions that are not what was asked for.

    ``packages``: ``package_id, n_questions, total_score, max_difficulty``; ``items``: ``package_id, item_id, score,
    difficulty, fingerprint, options, answer``; ``used``: fingerprints of earlier packages.
    """
    sums = items.groupBy("package_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.max("difficulty").alias("d"), F.count_distinct("item_id").alias("u"))
    p = packages.join(sums, "package_id", "left")
    tests = {
        "package:count": ~F.col("n").eqNullSafe(F.col("n_questions")),
        "package:score": F.abs(F.coalesce("s", F.lit(0.0)) - F.col("total_score")) > 1e-9,
        "package:difficulty": F.col("d") > F.col("max_difficulty"),
        "package:ids": F.col("u") < F.col("n"),
    }
    codes = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))
    whole = p.select("package_id", F.explode(codes).alias("rule")).select("rule", F.col("package_id").cast("string").alias("key"), F.lit("package").alias("detail"))
    again = violation(items.join(used.select("fingerprint"), "fingerprint", "left_semi"), "package:reused", F.col("package_id"), F.col("fingerprint"))
    options = items.filter((F.size(F.array_distinct("options")) < 3) | ~F.array_contains("options", F.col("answer")))
    return whole.unionByName(again).unionByName(violation(options, "package:options", F.col("package_id"), F.col("item_id")))


def delta_invariant(outcomes: DataFrame, key: str) -> DataFrame:
    """V15. Outcomes whose delta is not after less before."""
    off = F.abs(F.col("after") - F.col("before") - F.col("delta")) > 1e-9
    return violation(outcomes.filter(off), "delta", F.col(key), F.col("delta"))


def plan_invariant(plan: DataFrame, students: DataFrame) -> DataFrame:
    """V15. Plans longer than the week allows."""
    total = plan.groupBy("student_id").agg(F.sum("minutes").alias("m")).join(students, "student_id")
    return violation(total.filter(F.col("m") > F.col("weekly_available_minutes")), "plan_budget", F.col("student_id"), F.col("m"))


def array_ids_unique(df: DataFrame, column: str, key: str) -> DataFrame:
    """V15. Arrays that repeat an id."""
    return violation(df.filter(F.size(F.array_distinct(column)) < F.size(column)), f"array_unique:{column}", F.col(key), F.size(column))


def same_parent(children: DataFrame, parents: DataFrame, key: str, owner: str) -> DataFrame:
    """V15. Children whose owner is not their parent's."""
    joined = children.alias("c").join(parents.alias("p"), F.col(f"c.{key}") == F.col(f"p.{key}"))
    bad = joined.filter(~F.col(f"c.{owner}").eqNullSafe(F.col(f"p.{owner}")))
    return violation(bad, f"same_{owner}", F.col(f"c.{key}"), F.col(f"c.{owner}"))


def production_metrics(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """V16. One row of counts."""
    n_skills = skills.agg(F.count("*").alias("skill_rows"), F.count_distinct("job_id").alias("jobs_with_skill"))
    one = jobs.agg(
        F.count("*").alias("job_count"),
        F.count_distinct("source_id").alias("source_count"),
        F.count("career_id").alias("mapped_careers"),
        F.count_if(F.coalesce("salary_disclosed", F.lit(False))).alias("salary_disclosed"),
        F.count_if(F.col("work_mode") == "REMOTE").alias("remote"),
        (F.count("*") - F.count_distinct("job_id")).alias("duplicate_ids"),
    )
    return one.crossJoin(n_skills)  # one row beside one row
