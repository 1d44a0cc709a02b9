"""Titles to careers and texts to skills, by alias tables of any size.

An alias is looked for only where its longest word, or pair of words, stands: aliases go to the texts if they are few, and
else meet the hashes of the texts' words in a join; patterns run on what that finds. Titles whose words hold an alias's, or
are held by them, meet it by the rarest word; the others meet by prefixes of rare words, and in blocks of alike lengths.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import clean_title, extraction_text, match_text, text_or_empty
from marketloom.sources.versions import kept

#: So many words of aliases at most are compared with a text's words in its row.
MOST_WORDS = 5_000
#: Aliases of so many characters at most in all are sent to every task.
SENT_CHARS = 5_000_000
#: Columns of 64 bits that mark a text's words: a text that holds all words of another has all of its bits.
MARKS = ["_mark0", "_mark1"]
#: So many characters of titles or aliases are compared with one another in one block, about.
BLOCK_CHARS = 1_000_000
# Marks of a sentence that takes a requirement back or softens it.
NEGATIONS = ["không bắt buộc", "không yêu cầu", "không cần", "not required"]
PREFERENCES = ["là lợi thế", "ưu tiên", "preferred", "nice to have"]
PRIORITY = ["not_required", "mentioned", "preferred", "required"]
META = r"([\\.\[\]{}()*+?^$|\-/&#~])"


def alias_dim(entities: DataFrame) -> DataFrame:
    """S5. ``id, name, alias, entity_ord, alias_ord`` from ``id, name, aliases, entity_ord``; blank aliases go."""
    flat = entities.select("id", "name", "entity_ord", F.posexplode("aliases").alias("alias_ord", "raw"))
    return flat.select("id", "name", match_text("raw", markup=False).alias("alias"), "entity_ord", "alias_ord").filter("alias <> ''")


def whole_word(alias: Column) -> Column:
    """A pattern for ``alias`` that stands between other characters than letters, digits and underscores."""
    return F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace(alias, META, r"\\$1"), F.lit(r"(?!\w)"))


def match_exact(titles: DataFrame, dim: DataFrame) -> DataFrame:
    """M1. Titles (``title``) that equal an alias; the first in the taxonomy's order."""
    best = F.min_by(F.struct("id", "name"), F.struct("entity_ord", "alias_ord")).alias("m")
    return titles.join(dim, F.col("title") == F.col("alias")).groupBy("title").agg(best).select("title", "m.id", "m.name", F.lit(1.0).alias("score"))


def word_marks(words: Column) -> list[Column]:
    """The columns ``MARKS`` of an array of words: each word sets one bit, by its hash."""
    bits = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * len(MARKS))).cast("int"))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b % 64)
    part = lambda k: F.filter(bits, lambda b: F.floor(b / 64) == k)
    return [F.aggregate(part(k), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(one(b))).alias(c) for k, c in enumerate(MARKS)]


def may_hold(marks: list[str], of: list[str]) -> Column:
    """Whether the words marked by ``marks`` may hold all that ``of`` marks; true wherever they do."""
    held = [F.bitwise_not(F.col(a)).bitwiseAND(F.col(b)) == 0 for a, b in zip(marks, of)]
    return F.array_min(F.array(*held))


def _few(dim: DataFrame) -> bool:
    return (dim.agg(F.sum(F.length("alias"))).first()[0] or 0) <= SENT_CHARS


def _meeting(texts: DataFrame, low: str, dim: DataFrame) -> DataFrame:
    """Rows of ``texts`` with those of ``dim`` whose alias's longest word stands in ``low`` (in lower case) as a word.

    An alias between other characters than word characters has only whole words of the text. One without a word
    character meets the texts that have its first character. If the aliases are few (``SENT_CHARS``) and have
    ``MOST_WORDS`` different longest words at most, they are sent to the texts. More of them meet hashes of the texts'
    words, or of two neighbouring words if they have two, in a join, which passes on those whose words the text may hold
    by the marks of both; the texts come to what was found, once.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    longest = lambda c: F.get(F.array_sort(F.transform(c, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    keyed = dim.withColumn("_word", F.coalesce(longest(words("alias")), F.substring("alias", 1, 1)))
    keys = [r["_word"] for r in keyed.select("_word").distinct().limit(MOST_WORDS + 1).collect()]
    said = words(low)
    odd = F.regexp_extract_all(low, F.lit(r"(?U)[^\w\s]"), F.lit(0))
    if len(keys) <= MOST_WORDS and _few(dim):
        if any(not re.match(r"\w", k) for k in keys):
            said = F.concat(said, odd)
        said = F.array_intersect(said, F.lit(keys).cast("array<string>"))
        return texts.withColumn("_word", F.explode(F.array_distinct(said))).join(F.broadcast(keyed), "_word").drop("_word")
    pairs = lambda c: F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    # the last word has none after it: it is then a pair by itself, which meets aliases of one word only
    keyed = dim.withColumn("_word", F.xxhash64(F.coalesce(F.when(F.size(words("alias")) > 1, longest(F.slice(pairs(words("alias")), 1, F.size(words("alias")) - 1))), longest(words("alias")), F.substring("alias", 1, 1))))
    keyed = keyed.select("*", *(c.alias(f"{n}_of") for c, n in zip(word_marks(words("alias")), MARKS)))
    marked = texts.withColumn("_at", F.unhex(F.md5(low)))
    hashed = F.transform(F.array_distinct(F.concat(said, pairs(said), odd)), lambda x: F.xxhash64(x))
    # in two steps, so that marks are made once a text and not once a word
    flat = marked.select("_at", *word_marks(said), hashed.alias("_words")).select("_at", *MARKS, F.explode("_words").alias("_word"))
    met = flat.join(keyed, "_word").filter(may_hold(MARKS, [f"{n}_of" for n in MARKS])).groupBy("_at").agg(F.collect_set(F.struct(*dim.columns)).alias("_met"))
    return marked.join(met, "_at").drop("_at").select(*texts.columns, F.inline("_met"))


def _ranked(dim: DataFrame) -> DataFrame:
    """``dim`` with a ``rank`` by which the longest aliases come first, then those that the taxonomy has first."""
    order = [-F.length("alias"), *(c for c in ("entity_ord", "alias_ord", "alias", "id") if c in dim.columns)]
    return kept(dim.orderBy(*order).withColumn("rank", F.monotonically_increasing_id()), "ranked")


def match_contained(titles: DataFrame, dim: DataFrame, least_chars: int = 8) -> DataFrame:
    """M2. The longest alias of two words or more within a title, on word bounds."""
    long = _ranked(dim.filter((F.length("alias") >= least_chars) & F.col("alias").contains(" ")))
    met = _meeting(titles.select("title"), "title", long.select("alias", "rank")).withColumn("pattern", whole_word(F.col("alias")))
    best = met.filter(F.expr("contains(title, alias) AND rlike(title, pattern)")).groupBy("title").agg(F.min("rank").alias("rank"))
    return best.join(long.select("rank", "id", "name"), "rank").select("title", "id", "name", F.lit(0.96).alias("score"))


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Normalised Indel similarity: twice the longest common subsequence over both lengths."""
    return 2 * _common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of word sets: 1 if one holds the other, else the best of three joinings of common and own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [indel_ratio(one, two)]
    if both:
        scores += [2 * len(both) / (len(both) + len(s)) for s in (one, two)]
    return max(scores)


def word_set(text: str) -> Column:
    """The different words of a text, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")))


def _worded(df: DataFrame, c: str) -> DataFrame:
    """``id, c, words, n`` and marks: different strings with a word, their words in order, and the length of these with spaces."""
    rows = df.select(c, word_set(c).alias("words")).filter("size(words) > 0").dropDuplicates([c])
    return rows.select(F.unhex(F.md5(c)).alias("id"), c, "words", F.length(F.array_join("words", " ")).alias("n"), *word_marks(F.col("words")))


def _rare(words: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """``id, word``: each id's rarest words, until those before are longer than ``share`` of its length ``n``."""
    before = F.sum(F.length("word") + 1).over(W.partitionBy("id").orderBy("count", "word").rowsBetween(W.unboundedPreceding, -1))
    flat = words.join(counts, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return flat.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= share * F.col("n") + 1e-9).select("id", "word")


def _short(df: DataFrame) -> int:
    """The length ``n`` up to which the strings have ``SENT_CHARS`` characters at most in all."""
    # that many characters can't have more different lengths than this
    lengths = df.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").limit(int((2 * SENT_CHARS) ** 0.5) + 2).collect()
    total, at = 0, 0
    for r in lengths:
        total += r["n"] * r["c"]
        if total > SENT_CHARS:
            break
        at = r["n"]
    return at


def _held(small: DataFrame, key: str, large: DataFrame, of: str, counts: DataFrame, sent) -> DataFrame:
    """Pairs ``id, rank`` (``key`` and ``of``) where all words of ``small`` are words of ``large``, which has its rarest one.

    The fewer words, the more texts hold them. So the shortest strings, ``SENT_CHARS`` in all, are sent to the others and
    looked for in their rows, and their pairs are never shuffled. The rest meet by the rarest word, and get the words only
    where the marks of both let the one hold the other. Strings with a word that ``counts`` lacks are held by none.
    """
    words = small.select(key, F.size("words").alias("size"), F.explode("words").alias("word")).join(sent(counts), "word")
    rarest = words.groupBy(key, "size").agg(F.min(F.struct("count", "word")).alias("m"), F.count("*").alias("known")).filter("known = size").select(key, "m.word")
    theirs = [f"{c}_of" for c in MARKS]
    keyed = kept(rarest.join(small.select(key, "n", F.col("words").alias("_words"), *(F.col(c).alias(d) for c, d in zip(MARKS, theirs))), key), "rarest")
    holds = F.size(F.array_except("_words", "words")) == 0
    short = F.col("n") <= _short(keyed)
    flat = large.select(of, "words", *MARKS, F.explode("words").alias("word"))
    found = flat.join(F.broadcast(keyed.filter(short).select(key, "word", "_words")), "word").filter(holds).select("id", "rank")
    far = keyed.filter(~short)
    if far.isEmpty():
        return found
    met = flat.drop("words").join(far.drop("_words", "n"), "word").filter(may_hold(MARKS, theirs)).select("id", "rank")
    return found.unionAll(met.join(far.select(key, "_words"), key).join(large.select(of, "words"), of).filter(holds).select("id", "rank"))


def letter_counts(texts: list[str], kinds: int = 64) -> np.ndarray:
    """How often characters occur in each text, characters of equal remainder by ``kinds`` alike."""
    out = np.zeros((len(texts), kinds), dtype=np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % kinds, minlength=kinds)
    return out


def _alike(titles: DataFrame, aliases: DataFrame, least: float) -> DataFrame:
    """``id, rank, score``: pairs that are alike as strings, compared in blocks of lengths that are close.

    Of strings of ``n`` and ``m`` letters that reach ``least``, the lengths differ by ``bound`` at most, and the counts of
    letters by ``(1 - least) (n + m)`` in all, whatever the order of the words. The ratio is worked out where both hold.
    """
    bound = least / (2 - least)
    step = F.floor(F.log("n") / log(1 / bound) + 1e-9)
    rows = lambda df, key: df.select(F.col(key).alias("id"), "n", F.array_join("words", " ").alias("s"))
    # lengths by steps in which they may differ: those of neighbouring steps meet
    left = rows(titles, "id").withColumn("step", F.explode(F.array(*(step + d for d in (-1, 0, 1)))))
    right = rows(aliases, "rank").withColumn("step", step)
    blocks = [df.groupBy("step").agg(F.ceil(F.sum("n") / BLOCK_CHARS).alias(c)) for df, c in ((left, "_nl"), (right, "_nr"))]
    blocks = F.broadcast(blocks[0].join(blocks[1], "step"))  # one row a step
    dealt = lambda df, own, other: df.join(blocks, "step").select("id", "n", "s", "step", F.pmod(F.xxhash64("id"), own).alias(f"_b{own[2:]}"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"_b{other[2:]}"))
    key = ["step", "_bl", "_br"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            b = b.sort_values("n")
            n, ids, texts = b["n"].to_numpy(), b["id"].to_list(), b["s"].to_list()
            ours, theirs = letter_counts(a["s"].to_list()), letter_counts(texts)
            for i, m, s, mine in zip(a["id"], a["n"], a["s"], ours):
                lo, hi = np.searchsorted(n, m * bound - 1e-6), np.searchsorted(n, m / bound + 1e-6, "right")
                apart = np.abs(theirs[lo:hi] - mine).sum(axis=1)
                for k in lo + np.flatnonzero(apart <= (1 - least) * (n[lo:hi] + m) + 1e-6):
                    score = token_set_ratio(s, texts[k])
                    if score >= least:
                        found.append((i, ids[k], score))
        return pd.DataFrame(found, columns=["id", "rank", "score"])

    met = dealt(left, "_nl", "_nr").groupBy(*key).cogroup(dealt(right, "_nr", "_nl").groupBy(*key))
    return met.applyInPandas(compare, "id binary, rank long, score double")


def match_fuzzy(titles: DataFrame, dim: DataFrame, least: float = 0.90) -> DataFrame:
    """M3. The alias most like a title by token-set ratio, of equally like ones the longest, then the first; from ``least`` on.

    Meant for the distinct titles that nothing else matched. Neither titles nor aliases are gathered anywhere. The ratio is
    1 just where one's words hold the other's, so these pairs come first and settle their titles. For the others, a pair
    reaches ``least`` in one of two ways:

    * Its common words make up so much of one of the two that the other's words don't matter. So the rarest words of that
      side, up to the length that may be missing, hold a common word; all words of the other are asked.
    * The words, common ones first, are alike as strings (``_alike``).
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be over 0.5, and 1 at most")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    bound = least / (2 - least)
    asked = kept(_worded(titles.filter("title is not null"), "title"), "titles")
    first = dim.groupBy("alias").agg(F.min(F.struct("entity_ord", "alias_ord", "id", "name")).alias("e"))
    named = _worded(dim.filter("alias is not null"), "alias").join(first, "alias")
    aliases = _ranked(named.select("alias", "words", "n", *MARKS, F.col("e.entity_ord").alias("entity_ord"), F.col("e.alias_ord").alias("alias_ord"), F.col("e.id").alias("entity"), F.col("e.name").alias("name")))
    sent = F.broadcast if _few(aliases) else lambda df: df
    flat = lambda df, key: df.select(F.col(key).alias("id"), "n", F.explode("words").alias("word"))
    alias_words, words = flat(aliases, "rank"), flat(asked, "id")
    known = words.join(sent(alias_words.select("word").distinct()), "word", "left_semi")
    counts = kept(known.select("word").unionAll(alias_words.select("word")).groupBy("word").agg(F.count("*").alias("count")), "words")
    either = _held(aliases, "rank", asked, "id", counts, sent).unionAll(_held(asked, "id", aliases, "rank", counts, sent))
    settled = kept(either.groupBy("id").agg(F.min("rank").alias("rank")), "settled")
    found = settled.select("id", F.lit(1.0).alias("score"), "rank")
    if least < 1:
        rest = kept(asked.join(settled, "id", "left_anti"), "rest")
        rest_words = flat(rest, "id")
        named = lambda df: df.select(F.col("id").alias("rank"), "word")
        of_alias = _rare(alias_words, sent(counts), 1 - bound)
        met = rest_words.join(sent(named(of_alias)), "word").select("id", "rank")
        met = met.unionAll(_rare(rest_words, sent(counts), 1 - bound).join(sent(named(alias_words)), "word").select("id", "rank"))
        theirs = aliases.select("rank", F.col("words").alias("_words"), F.col("n").alias("_n"))
        pairs = met.distinct().join(sent(theirs), "rank").join(rest.select("id", "words", "n"), "id")
        common = F.length(F.array_join(F.array_intersect("words", "_words"), " "))
        holding = pairs.filter(common + 1e-6 >= bound * F.least("n", "_n")).withColumn("score", ratio(F.array_join("words", " "), F.array_join("_words", " "))).filter(F.col("score") >= least)
        scored = holding.select("id", "rank", "score").unionAll(_alike(rest, aliases, least))
        best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank")).alias("m"))
        found = found.unionAll(best.select("id", -F.col("m.s"), "m.rank"))
    placed = found.join(asked.select("id", "title"), "id").select("title", F.round("score", 3).alias("score"), "rank")
    return placed.join(sent(aliases.select("rank", F.col("entity").alias("id"), "name")), "rank").select("title", "id", "name", "score")


def match_career(df: DataFrame, title_col: str, dim: DataFrame, markup: bool = True) -> DataFrame:
    """M4. ``career_id, career_name, career_confidence``: exact, then contained, then fuzzy, by distinct title."""
    keyed = df.withColumn("_title", clean_title(title_col, markup))
    titles = kept(keyed.select(F.col("_title").alias("title")).distinct(), "titles")
    dim = kept(dim, "dim")
    exact = match_exact(titles, dim)
    rest = titles.join(exact, "title", "left_anti")
    contained = kept(match_contained(rest, dim), "contained")
    fuzzy = match_fuzzy(rest.join(contained, "title", "left_anti"), dim)
    found = exact.unionByName(contained).unionByName(fuzzy)
    named = found.select(F.col("title").alias("_title"), F.col("id").alias("career_id"), F.col("name").alias("career_name"), F.col("score").alias("career_confidence"))
    return keyed.join(named, "_title", "left").drop("_title").withColumn("career_confidence", F.coalesce("career_confidence", F.lit(0.0)))


def requirement_level(sentence: Column, default: str) -> Column:
    """M7. ``level`` and ``confidence`` of a skill named in this sentence."""
    has = lambda marks: sentence.rlike("|".join(map(re.escape, marks)))
    made = lambda level, confidence: F.struct(F.lit(level).alias("level"), F.lit(confidence).alias("confidence"))
    return F.when(has(NEGATIONS), made("not_required", 0.98)).when(has(PREFERENCES), made("preferred", 0.95)).otherwise(made(default, 0.85 if default == "mentioned" else 0.90))


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """M6. ``id, pos, sentence``: stretches between full stops, semicolons and line ends."""
    return df.select(id_col, F.posexplode(F.split(text_or_empty(text_col), r"[.;\n]")).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence")).filter("sentence <> ''")


def extract_skills(df: DataFrame, id_col: str, text_col: str, dim: DataFrame, default: str = "required", markup: bool = True) -> DataFrame:
    """M5. Skills of each text: ``id, skill_id, skill_name, raw_mention, requirement_level, confidence``, one row a skill.

    Aliases are found on word bounds anywhere in the text; the sentence around a find decides its level. Of several
    finds of a skill the strongest level counts, then the first alias, then the first place.
    """
    if default not in ("required", "preferred", "mentioned"):
        raise ValueError("default must be required, preferred or mentioned")
    texts = df.select(F.col(id_col), extraction_text(text_col, markup).alias("_text")).withColumn("_low", F.lower("_text")).withColumn("_marks", F.translate("_low", ".;", "\n\n"))
    near = _meeting(texts, "_low", dim.withColumn("pattern", whole_word(F.col("alias"))))
    hits = near.filter(F.expr("contains(_low, alias) AND rlike(_low, pattern)"))
    # the text is split at the finds; one pass over the parts sums up where each find starts
    size = F.length("alias")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + size).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(x))).alias("out"))
    starts = F.aggregate(F.expr("split(_low, pattern, -1)"), zero, step, lambda acc: F.slice(acc["out"], 1, F.size(acc["out"]) - 1))
    places = hits.select(id_col, "id", "name", "alias_ord", "_text", "_low", "_marks", size.alias("n"), F.explode_outer(starts).alias("at")).filter("at is not null")
    before = F.expr("substring_index(substring(_marks, 1, at), '\\n', -1)")
    after = F.expr("substring_index(substring(_marks, at + n + 1), '\\n', 1)")
    level = requirement_level(F.concat(before, F.expr("substring(_low, at + 1, n)"), after), default)
    found = places.select(id_col, "id", "name", "alias_ord", "at", F.expr("substring(_text, at + 1, n)").alias("raw"), level.alias("l"))
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("l.level"))
    best = F.min_by(F.struct("name", "raw", "l"), F.struct(-rank, "alias_ord", "at")).alias("m")
    return found.groupBy(id_col, "id").agg(best).select(
        id_col, F.col("id").alias("skill_id"), F.col("m.name").alias("skill_name"), F.col("m.raw").alias("raw_mention"), F.col("m.l.level").alias("requirement_level"), F.col("m.l.confidence").alias("confidence")
    )


def extract_skills_from_tags(df: DataFrame, id_col: str, tags_col: str, dim: DataFrame) -> DataFrame:
    """M8. Skills of a list of tags, each read by itself; of several tags for a skill the last wins."""
    tags = df.select(id_col, F.posexplode(tags_col).alias("pos", "tag"))
    distinct = tags.select("tag").distinct()
    known = extract_skills(distinct, "tag", "tag", dim, "required")
    best = F.max_by(F.struct("skill_name", "raw_mention", "requirement_level", "confidence"), "pos").alias("m")
    return tags.join(known, "tag").groupBy(id_col, "skill_id").agg(best).select(id_col, "skill_id", "m.*")
