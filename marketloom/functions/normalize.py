"""Field normalisers: raw strings of postings to typed columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import clean_text, col, match_text, plain_text, text_or_empty

# The words that decide, in order of trial.
REMOTE = ["việc làm tại nhà", "làm việc tại nhà", "work from home", "remote", "wfh", "từ xa"]
HYBRID = ["hybrid", "làm việc kết hợp", "kết hợp tại nhà"]
ONSITE = ["onsite", "on-site", "làm việc tại văn phòng", "làm việc tại công ty"]
NEGOTIABLE = ["thỏa thuận", "thoả thuận", "negotiable"]
FRESHER = ["không yêu cầu", "mới tốt nghiệp", "fresher"]
INTERN = ["intern", "thực tập"]
EDUCATION = [("trung cấp", "vocational_or_above"), ("cao đẳng", "college_or_above"), ("đại học", "university_or_above")]


def any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


#: So many first characters of a location's alias are looked up in a text.
KEY_CHARS = 3


def province(df: DataFrame, text_col: str, locations: DataFrame, out: str = "province", markup: bool = True) -> DataFrame:
    """N1. The first location, in the taxonomy's order, one of whose aliases is in the text.

    ``locations`` is an alias table (``name, alias, entity_ord, alias_ord``) of one taxonomy. Distinct texts are matched,
    not rows; a text meets the aliases that begin with characters in a row of it, in a join on these, and no others.
    """
    key = match_text(text_col, markup)
    keyed = df.withColumn("_loc", key)
    distinct = keyed.select("_loc").distinct()
    size = F.least(F.length("alias"), F.lit(KEY_CHARS))
    aliases = locations.filter("alias <> ''").select("name", "alias", "entity_ord", "alias_ord", F.expr(f"substring(alias, 1, {KEY_CHARS})").alias("_gram"))
    sizes = sorted(r["n"] for r in aliases.select(size.alias("n")).distinct().collect())  # KEY_CHARS numbers at most
    rows = lambda n: F.when(F.length("_loc") >= n, F.transform(F.sequence(F.lit(1), F.length("_loc") - n + 1), lambda i: F.col("_loc").substr(i, F.lit(n))))
    grams = F.flatten(F.array_compact(F.array(*map(rows, sizes)))) if sizes else F.array().cast("array<string>")
    met = distinct.select("_loc", F.explode(F.array_distinct(grams)).alias("_gram")).join(aliases, "_gram")
    found = met.filter(F.col("_loc").contains(F.col("alias"))).groupBy("_loc")
    best = found.agg(F.min_by("name", F.struct("entity_ord", "alias_ord")).alias(out))
    return keyed.join(best, "_loc", "left").drop("_loc")


def work_mode(work_mode_raw, location_raw, description_raw=None, markup: bool = True) -> Column:
    """N2. REMOTE before HYBRID before ONSITE."""
    clean = clean_text if markup else plain_text
    parts = [clean(c) for c in (work_mode_raw, location_raw, description_raw) if c is not None]
    text = F.lower(F.concat_ws(" ", *parts))
    return (
        F.when(any_of(text, REMOTE), "REMOTE").when(any_of(text, HYBRID), "HYBRID").when(any_of(text, ONSITE), "ONSITE").otherwise("UNSPECIFIED")
    )


def salary(raw, markup: bool = True) -> Column:
    """N3. Struct of ``min_vnd, max_vnd, mid_vnd, disclosed`` from millions: a range, a least, a most or one figure."""
    text = F.replace(match_text(raw, markup), F.lit(","), F.lit("."))
    # fixed values: how pay is written
    number, unit = r"(\d+(?:\.\d+)?)", r"(?:triệu|tr|m)"
    amount = lambda p, k: (F.nullif(F.regexp_extract(text, p, k), F.lit("")).cast("double") * 1_000_000).cast("bigint")
    both = rf"(?U){number}\s*{unit}?\s*[-–—]\s*{number}\s*{unit}"
    least, most, one = rf"(?U)(?:từ|>=|trên)\s*{number}\s*{unit}", rf"(?U)(?:up to|upto|tới|đến|<=)\s*{number}\s*{unit}", rf"(?U){number}\s*{unit}"
    none = F.lit(None).cast("bigint")

    def made(low, high, mid, known) -> Column:
        return F.struct(low.alias("min_vnd"), high.alias("max_vnd"), mid.cast("double").alias("mid_vnd"), F.lit(known).alias("disclosed"))

    low, high = amount(both, 1), amount(both, 2)
    return (
        F.when((text == "") | any_of(text, NEGOTIABLE), made(none, none, none, False))
        .when(text.rlike(both), made(low, high, (low + high) / 2, True))
        .when(text.rlike(least), made(amount(least, 1), none, none, True))
        .when(text.rlike(most), made(none, amount(most, 1), none, True))
        .when(text.rlike(one), made(amount(one, 1), amount(one, 1), amount(one, 1), True))
        .otherwise(made(none, none, none, False))
    )


def seniority(raw, markup: bool = True) -> Column:
    """N4. By words, else by the largest number in the text."""
    text = match_text(raw, markup)
    most = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)")))
    return (
        F.when(any_of(text, FRESHER), "fresher")
        .when(any_of(text, INTERN), "intern")
        .when(text.contains("dưới 1 năm"), "junior")
        .when(most.isNull(), "unknown")
        .when(most <= 2, "junior")
        .when(most <= 5, "mid")
        .otherwise("senior")
    )


def education(raw, markup: bool = True) -> Column:
    """N5. The first step of the ladder that is named."""
    text = match_text(raw, markup)
    level = F.when((text == "") | text.contains("không yêu cầu"), "no_formal_requirement")
    for word, name in EDUCATION:
        level = level.when(text.contains(word), name)
    return level.otherwise("unknown")


def posted_date(raw, collected_at, markup: bool = True) -> Column:
    """N6. Today, yesterday, so many days ago, or a date written day first; else null."""
    text, day = match_text(raw, markup), col(collected_at).cast("date")
    ago = F.nullif(F.regexp_extract(text, r"(?U)(\d+)\s*ngày trước", 1), F.lit("")).cast("int")
    written = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    local = F.regexp_replace(written(r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{4}\b"), "[.-]", "/")
    dated = F.coalesce(F.try_to_date(written(r"\b\d{4}-\d{1,2}-\d{1,2}\b"), "yyyy-M-d"), F.try_to_date(local, "d/M/yyyy"))
    return (
        F.when(text.contains("hôm nay"), day)
        .when(text.contains("hôm qua"), F.date_sub(day, 1))
        .when(ago.isNotNull(), F.date_sub(day, ago))
        .otherwise(dated)
    )


def experience_years(description, markup: bool = True) -> Column:
    """N7. The smallest number of years asked for."""
    text = match_text(description, markup)
    # fixed values: how years of experience are written
    patterns = [
        r"(?U)(\d+(?:\.\d+)?)\s*\+?\s*(?:years?|yrs?)\b",
        r"(?U)(?:at least|minimum|min)\s*(\d+(?:\.\d+)?)\s*(?:years?|yrs?)\b",
        r"(?U)(\d+(?:\.\d+)?)\s*\+?\s*năm\b",
    ]
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))
    return F.array_min(F.transform(found, lambda x: x.cast("double")))


ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "addressCountry")


def posting_salary_location(json) -> dict[str, Column]:
    """N8. Pay and places of an embedded posting; a single place may stand for a list of one, a text or an object with a
    name for a part of an address or the whole of it. Broken JSON, and values of any other shape, give nulls.
    """
    posting = F.try_parse_json(text_or_empty(json))
    got = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    # objects and lists read as text would give their JSON
    plain = lambda v, path: F.when(~F.schema_of_variant(got(v, path, "variant")).rlike("^(OBJECT|ARRAY)"), F.nullif(F.trim(got(v, path)), F.lit("")))
    part = lambda x, k: F.coalesce(plain(x, f"$.address.{k}"), plain(x, f"$.address.{k}.name"))
    place = lambda x: F.coalesce(plain(x, "$.address"), F.array_join(F.array_compact(F.array(*(part(x, k) for k in ADDRESS))), ", "))
    listed = F.coalesce(got(posting, "$.jobLocation", "array<variant>"), F.array(got(posting, "$.jobLocation", "variant")))
    places = F.filter(F.array_distinct(F.transform(F.array_compact(listed), place)), lambda x: x != "")
    pay = lambda k, kind="double": F.coalesce(got(posting, f"$.baseSalary.value.{k}", kind), got(posting, "$.baseSalary.value.value", kind))
    return {
        "currency": plain(posting, "$.baseSalary.currency"),
        "salary_min": pay("minValue"),
        "salary_max": pay("maxValue"),
        "salary_unit": plain(posting, "$.baseSalary.value.unitText"),
        "location": F.nullif(F.array_join(places, " | "), F.lit("")),
    }


SOURCE_CONFIDENCE = {"board_api": 1.0}


def overall_confidence(title_confidence, province_col, n_skills, text) -> Column:
    """N9. Mean of four signs: title, place, skills and text."""
    known = lambda c, otherwise: F.when(c, 1.0).otherwise(otherwise)
    parts = [
        F.coalesce(col(title_confidence), F.lit(0.0)),
        known(col(province_col).isNotNull(), 0.4),
        known(F.coalesce(col(n_skills), F.lit(0)) > 0, 0.3),
        known(text_or_empty(text) != "", 0.0),
    ]
    return F.round(sum(parts[1:], parts[0]) / 4, 3)


def source_confidence(source_type) -> Column:
    """N9. 1.0 for structured boards, 0.8 for read pages."""
    c = F.lit(0.8)
    for kind, value in SOURCE_CONFIDENCE.items():
        c = F.when(col(source_type) == kind, F.lit(value)).otherwise(c)
    return c
