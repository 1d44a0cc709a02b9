"""Chat formatting: collapse of cumulative snapshots, then rendering. DataFrame expressions only.

Loggers often store a conversation again at every turn, so that one snapshot is a prefix of the next. Each turn gets
a rolling hash: that of the turn before, with this turn's role and text. A conversation whose last hash is one of the
inner hashes of another is a prefix of it and goes; of equal ones the smallest id stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import let, running

# The template of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(before: Column, turn: Column) -> Column:
    """SHA-256 of the hash before and of role and text; lengths keep the two apart, and null from empty."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(before, part(turn["role"]), part(turn["text"])), 256)


def with_prefixes(conversations: DataFrame) -> DataFrame:
    """``conv_id``, its ``turns`` in order and their rolling hashes ``prefixes``."""
    turn = F.struct("turn", "role", "text")
    grouped = (
        conversations.filter(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    fresh = lambda ts: F.filter(ts, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(ts, i - 1)))
    grouped = grouped.select("conv_id", let(F.col("turns"), fresh).alias("turns"))

    def add(before: Column, x: Column) -> Column:
        return let(_turn_hash(before, x), lambda here: F.struct(here.alias("at"), F.array(here).alias("more")))

    return grouped.withColumn("prefixes", running(F.col("turns"), F.lit(""), "string", add))


def maximal(conversations: DataFrame) -> DataFrame:
    """The conversations that are neither a prefix of another nor a copy of one of smaller id."""
    chains = with_prefixes(conversations).withColumn("last", F.element_at("prefixes", -1))
    inner = chains.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("last")).distinct()
    first = chains.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return chains.drop("prefixes").join(first.join(inner, "last", "left_anti"), ["last", "conv_id"])


def rendered(turns: Column) -> Column:
    """One text of all turns; null roles and texts count as empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), empty(t["role"]), F.lit("\n"), empty(t["text"]), F.lit(CLOSE))), ""
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, text`` of every maximal conversation.

    ``conversations`` has one row a turn (``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored). Turns
    are ordered by number (nulls first), then role and text; rows equal in all three count once. Numbers order the
    turns and are not compared. Rows without ``conv_id`` belong to no conversation. ``n_copies`` counts the
    conversations with the same turns. An empty table gives no rows. As a conversation becomes one text, its turns are
    brought together in one row, however many they are; conversations never are.
    """
    return maximal(conversations).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", rendered(F.col("turns")).alias("text")
    )


SQL = """
with t as (
  select distinct conv_id, turn, role, text from conversations where conv_id is not null
), s as (
  select conv_id,
         coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') as part,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as shown,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k,
         count(*) over (partition by conv_id) as n
  from t
), p as (
  select conv_id, k, n, sha256(string_agg(part, '') over (partition by conv_id order by k rows unbounded preceding)) as h
  from s
), whole as (
  select h, min(conv_id) as conv_id, count(*) as n_copies from p where k = n group by h
)
select w.conv_id, count(*) as n_turns, any_value(w.n_copies) as n_copies, string_agg(s.shown, '' order by s.k) as text
from whole w join s on s.conv_id = w.conv_id
where w.h not in (select h from p where k < n)
group by w.conv_id
"""
