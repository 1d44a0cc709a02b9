"""Lookups and updates over service tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import fold_accents


def upsert_catalog(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Q1. Rows of ``new``, and those of ``current`` whose key is not in it."""
    return current.join(new, key, "left_anti").unionByName(new)


def replace_aliases(current: DataFrame, new: DataFrame, key: str, alias: str) -> DataFrame:
    """Q1. Aliases of the keys in ``new`` replaced; of aliases equal without accents the smallest stays."""
    kept = current.join(new.select(key).distinct(), key, "left_anti")
    once = new.groupBy(key, fold_accents(alias).alias("_f")).agg(F.min(alias).alias(alias)).drop("_f")
    return kept.select(key, alias).unionByName(once.select(key, alias))


def search_catalog(df: DataFrame, name: str, text: str, term: str, n: int, active: str | None = None) -> DataFrame:
    """Q2. The first ``n`` by name of the rows that hold ``term`` (accents aside), with the number of all."""
    folded = fold_accents(F.lit(term))
    rows = df.filter(F.col(active)) if active else df
    hits = rows.filter(fold_accents(text).contains(folded) | fold_accents(name).contains(folded))
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(name).limit(n).crossJoin(total)  # n rows beside one


def career_detail(careers: DataFrame, aliases: DataFrame, key: str, alias: str) -> DataFrame:
    """Q3. Careers with their aliases in order."""
    lists = aliases.groupBy(key).agg(F.array_sort(F.collect_list(alias)).alias("aliases"))
    return careers.join(lists, key, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def recent_per_key(df: DataFrame, key: list[str], at: str, tie: str, n: int) -> DataFrame:
    """Q4, Q9. The ``n`` latest rows of each key with their rank, rows without a time last."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.col(tie)))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def match_results(results: DataFrame, careers: DataFrame) -> DataFrame:
    """Q5. Ranked items with career names; unknown careers have none."""
    return results.join(careers.select("career_id", "career_name"), "career_id", "left")


#: Q6. Parts that a key's users are dealt to, and lists that its profiles come in.
ROSTER_SLOTS, ROSTER_LISTS = 32, 16


def roster(users: DataFrame, profiles: DataFrame, by: list[str]) -> DataFrame:
    """Q6. Users and profiles of the same tenant and class.

    There is a row for every pair, however few bytes the inputs have: so a key's users are dealt to ``ROSTER_SLOTS`` parts
    and these to all shuffle partitions, and they meet the key's profiles in lists, which are taken apart afterwards.
    """

    def dealt(df: DataFrame, parts: int) -> Column:
        plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        return F.pmod(F.xxhash64(*plain), F.lit(parts)).cast("int")

    tasks = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [F.col(c) for c in profiles.columns if c not in by]
    lists = profiles.groupBy(*by, dealt(profiles, ROSTER_LISTS).alias("_list")).agg(F.collect_list(F.struct(*others or [F.lit(0)])).alias("_profiles"))
    lists = lists.drop("_list").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(ROSTER_SLOTS - 1))))
    left = users.withColumn("_slot", dealt(users, ROSTER_SLOTS))
    # a stated number of partitions, as adaptive execution would merge them by their few bytes; merge: nothing is broadcast once a slot
    left, right = (df.repartition(tasks, *by, "_slot") for df in (left, lists))
    pairs = left.join(right.hint("merge"), [*by, "_slot"]).drop("_slot").withColumn("_profiles", F.explode("_profiles"))
    return pairs.select(*by, *(c for c in users.columns if c not in by), *(["_profiles.*"] if others else []))


def removed(profiles: DataFrame, class_col: str) -> DataFrame:
    """Q6. Profiles without a class."""
    return profiles.filter(F.col(class_col).isNull())


def valid_assignments(df: DataFrame, day: Column, start: str = "starts_at", end: str = "ends_at") -> DataFrame:
    """Q7. Rows whose interval holds the day; an open end never ends."""
    return df.filter((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day)))


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Q7. Points within intervals of the same key; an open end never ends."""
    return points.join(intervals, by).filter((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(end) >= F.col(at))))


def latest_status(members: DataFrame, events: DataFrame, key: str, at: str, tie: str, status: str, none: str = "not_started") -> DataFrame:
    """Q8. Each member's status by its latest event."""
    last = events.groupBy(key).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.max(at).alias("latest_at"))
    return members.select(key).join(last, key, "left").withColumn("status", F.coalesce("status", F.lit(none)))


def merge_drafts(state: DataFrame, changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Q10. Answers after changes; an empty value deletes. A change set whose expected version is not the current one
    is rejected as a whole.

    ``state``: ``draft_id, question_id, answer``; ``changes`` adds ``expected_version``; ``versions``: ``draft_id, version``.
    """
    good = changes.join(versions, (changes.draft_id == versions.draft_id) & (changes.expected_version == versions.version), "left_semi")
    new = good.select("draft_id", "question_id", F.col("answer").alias("_new"), F.lit(True).alias("_changed"))
    merged = state.join(new, ["draft_id", "question_id"], "full_outer")
    answer = F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("answer"))
    return merged.select("draft_id", "question_id", answer.alias("answer")).filter(F.coalesce("answer", F.lit("")) != "")


def student_snapshot(profiles: DataFrame, key: str, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q11. Profiles with related rows nested in order of their first columns."""
    out = profiles
    for name, (df, columns) in parts.items():
        lists = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(lists, key, "left")
    return out


def cascade_delete(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Q12. Both tables without the rows of the given keys."""
    return parents.join(ids, key, "left_anti"), children.join(ids, key, "left_anti")


def sample_balanced(df: DataFrame, group: str, id_col: str, k: int, seed: int) -> DataFrame:
    """Q13. ``k`` rows of each group by seeded hash; groups with fewer raise an error when read."""
    order = W.partitionBy(group).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    ranked = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    sizes = ranked.groupBy(group).agg(F.count("*").alias("_n"))
    short = F.when(F.col("_n") < k, F.raise_error(F.concat(F.lit("too few rows: "), F.col(group).cast("string"))).cast("boolean")).otherwise(True)
    return ranked.join(sizes, group).filter(short).drop("_n")  # one row a group, at most k of each


def keep_first(df: DataFrame, keys: list[str], order: list[str], cut=None) -> DataFrame:
    """Q13. The rows that stay when they are taken in ``order`` and a row goes if one *kept* before shares any of ``keys``.

    No single window gives this: a row that goes for one key hides nothing by its other ones. In each round the rows that
    come first in all their keys' groups are kept, and rows that share a key with one of them go; the first of all that are
    left is always kept, so it ends. Rounds are as many as the longest chain of rows of which each hides the next.
    Rows equal in ``order`` and ``keys`` count once; other ties in ``order`` are settled by ``keys``. A null key is shared
    with nothing. ``cut`` writes a round's rows and reads them back, so that plans stay short.
    """
    if cut is None:
        from marketloom.sources.versions import work_dir

        def cut(rows: DataFrame) -> DataFrame:
            path = work_dir(df.sparkSession, "keep-first")
            rows.write.parquet(path)
            return df.sparkSession.read.schema(rows.schema).parquet(path)

    place = F.struct(*order, *keys)
    left = cut(df.select(*order, *keys).distinct().withColumn("_place", place))
    kept = None
    while not left.isEmpty():
        first = F.lit(True)
        for k in keys:
            first = first & (F.col(k).isNull() | (F.min("_place").over(W.partitionBy(k)) == F.col("_place")))
        now = cut(left.filter(F.lit(True)).withColumn("_first", first))
        chosen = now.filter("_first").drop("_first")
        kept = chosen if kept is None else kept.unionByName(chosen)
        left = now.filter("not _first").drop("_first")
        for k in keys:
            left = left.join(chosen.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
        left = cut(left)
    return (left if kept is None else kept).select(*order, *keys)
