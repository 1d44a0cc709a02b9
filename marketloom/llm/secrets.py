"""Secret scans as DataFrame expressions: patterns with spans, and sliding-window entropy.

Base patterns give the kinds ``assign``, ``access`` and ``hex``. The method adds ``entropy``: over every candidate
string (a run of 20 or more characters of the base64 alphabets that holds a digit, or a run of 20 or more letters
that changes case as random ones do) a window of ``WINDOW`` characters slides; the counts of its characters, and with them the sum of ``c * log2(c)``, change by one character in and one
out a step. Windows whose Shannon entropy reaches the threshold of the candidate's character class are joined into
spans. Candidates on the allow-list add nothing; base spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import let, running

# The base patterns and the least lengths of what they match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
#: Letters that change case as random ones do: twice, one or two small ones between capitals. Joined words seldom do.
LETTERS = r"(?<![A-Za-z])(?=(?>[A-Za-z]*?[A-Z][a-z]{1,2}(?=[A-Z])){2})[A-Za-z]{20,}"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{20,}}|{LETTERS}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes in order of trial: (name, what a whole candidate looks like, bits a character in a window).
CLASSES = [
    ("digits", r"^[0-9]+$", math.inf),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("letters", r"^[A-Za-z]+$", 3.75),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^.*$", 3.7),
]
#: Candidates that are no secrets: UUIDs, counting sequences and words of examples (if no window lies beside them),
#: paths and hyphenated words (if each is all letters or all digits, and no letters look random). Repeated groups are
#: possessive: others recurse once a repetition, and a long candidate would exhaust the stack.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"^(?:.{{0,{WINDOW - 1}}}?(?:0123456789|(?i:abcdefgh|example|placeholder|changeme|dummy|sample|xxxx)))++.{{0,{WINDOW - 1}}}$",
    rf"^(?!.*?{LETTERS})[/-]?(?:[A-Za-z]+[/_-]|[0-9]+[/_-]){{2,}}+(?:[A-Za-z]*|[0-9]*)[/=-]?$",
]
#: Stands for no character of a text: marks matches in a copy of it. The text's own become the other one.
MARK, OTHER = "\u0001", "\u0002"


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("k"), end.cast("long").alias("end"), F.lit(kind).alias("kind")
    )


MATCHED = "struct<start:int,end:int,value:int,text:string>"
PLACE = "struct<start:bigint,end:bigint>"
#: Characters of a candidate that are handled together.
PART = 1024
#: Characters of a text that are read together when it is redacted.
READ = 4096


def _matches(shadow: Column, kind: str, pattern: str, groups: int, guard: str) -> Column:
    """The leftmost non-overlapping matches of ``pattern``: ``start, end``, the ``value``'s length and the ``text``.

    The matches are wrapped in marks, the text is split at the marks, and lengths are summed up.
    ``guard``: a text without it has no match that counts.
    """
    step = groups + 1
    marked = F.regexp_replace(shadow, F.lit(pattern), F.lit("".join([MARK, "$0", *[f"{MARK}$2"] * (groups - 1), MARK])))

    def spans(parts: Column) -> Column:
        def add(at: Column, i: Column) -> Column:
            text = F.get(parts, step * i + 1)
            start = at + F.length(F.get(parts, step * i))
            end = start + F.length(text)
            one = F.struct(start.alias("start"), end.alias("end"), F.length(F.get(parts, step * i + groups)).alias("value"), text.alias("text"))
            return F.struct(end.alias("at"), F.array(one).alias("more"))

        n = F.floor(F.size(parts) / step).cast("int")
        return running(F.sequence(F.lit(0), n - 1), F.lit(0), MATCHED, add)

    found = let(F.split(marked, MARK), spans)
    long_enough = F.filter(found, lambda x: x["value"] >= LEAST[kind]) if kind in LEAST else found
    return F.when(shadow.rlike(guard), long_enough).otherwise(F.array().cast(f"array<{MATCHED}>"))


def _pattern_spans(shadow: Column, kind: str, pattern: str, groups: int, guard: str) -> Column:
    return F.transform(_matches(shadow, kind, pattern, groups, guard), lambda x: _span(kind, x["start"], x["end"]))


def _joined(spans: Column) -> Column:
    """Overlapping and touching neighbours of ``spans`` as one; starts and ends both ascend."""
    before = lambda x, i: (i > 0) & (F.get(spans, i - 1)["end"] >= x["start"])
    after = lambda x, i: (i < F.size(spans) - 1) & (F.get(spans, i + 1)["start"] <= x["end"])
    starts = F.transform(F.filter(spans, lambda x, i: ~before(x, i)), lambda x: x["start"])
    ends = F.transform(F.filter(spans, lambda x, i: ~after(x, i)), lambda x: x["end"])
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def _hot(run: Column, start: Column, least_bits: Column, window: int) -> Column:
    """The windows of one run of characters whose entropy reaches ``least_bits``, overlapping ones joined.

    ``s`` is the sum of ``c * log2(c)`` over the counts of the window's characters. One character comes and one goes a
    step; their own counts, taken from the window, change the sum.
    """
    log = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    chars = F.regexp_extract_all(run, F.lit("."), F.lit(0))

    def over(c: Column) -> Column:
        count = lambda first, size, x: size - F.size(F.array_remove(F.slice(c, first, size), x))

        def step(at: Column, i: Column) -> Column:
            full = i >= window
            size = F.least(i, F.lit(window))  # characters before this one
            come, gone = F.get(c, i), F.get(c, i - window)
            n_in = count(i - size + 1, size, come)
            n_out = count(i - window + 1, F.lit(window), gone) + F.when(gone == come, 1).otherwise(0)
            s = at + log(n_in + 1) - log(n_in) + F.when(full, log(n_out - 1) - log(n_out)).otherwise(F.lit(0.0))
            here = F.struct((start + i - (window - 1)).cast("long").alias("start"), (start + i + 1).cast("long").alias("end"))

            def judged(total: Column) -> Column:
                hot = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= least_bits)
                return F.struct(total.alias("at"), F.when(hot, F.array(here)).otherwise(F.array().cast(f"array<{PLACE}>")).alias("more"))

            return let(s, judged)

        return running(F.sequence(F.lit(0), F.size(c) - 1), F.lit(0.0), PLACE, step)

    return let(let(chars, over), _joined)


def _windows(candidate: Column, start: Column, least_bits: Column, window: int) -> Column:
    """Spans of the windows of one candidate whose entropy reaches ``least_bits``, overlapping ones joined.

    Long candidates are cut into runs that share ``window - 1`` characters, so that each window lies in one of them.
    """

    def cut(parts: Column) -> Column:
        def one(part: Column, k: Column) -> Column:
            shared = F.coalesce(F.substring(F.get(parts, k + 1), 1, window - 1), F.lit(""))
            return _hot(F.concat(part, shared), start + k * PART, least_bits, window)

        return F.flatten(F.transform(parts, one))

    return let(let(F.regexp_extract_all(candidate, F.lit(f".{{1,{PART}}}"), F.lit(0)), cut), _joined)


def _entropy(shadow: Column, classes: Sequence[tuple[str, str, float]], allowed: Sequence[str], window: int) -> Column:
    """The method's spans of one text."""

    def of_candidate(at: Column) -> Column:
        c, bits, safe = at["text"], F.lit(math.inf), F.lit(False)
        for _, shape, least in reversed(classes):
            bits = F.when(c.rlike(shape), F.lit(least)).otherwise(bits)
        for pattern in allowed:
            safe = safe | c.rlike(pattern)
        return F.when(safe, F.array().cast(f"array<{PLACE}>")).otherwise(let(bits, lambda b: _windows(c, at["start"], b, window)))

    places = _matches(shadow, "entropy", CANDIDATE, 1, CANDIDATE)
    return F.transform(F.flatten(F.transform(places, of_candidate)), lambda x: _span("entropy", x["start"], x["end"]))


def secret_spans(
    text: Column,
    classes: Sequence[tuple[str, str, float]] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
    window: int = WINDOW,
) -> Column:
    """All spans of a text, by start, then kind: an array of ``start, k, end, kind`` (code points, end exclusive)."""
    shadow = F.translate(F.coalesce(text, F.lit("")), MARK, OTHER)

    def all_of(s: Column) -> Column:
        return F.sort_array(
            F.concat(
                _pattern_spans(s, "assign", ASSIGN, 2, ASSIGN.removesuffix("+)") + "{8})"),
                _pattern_spans(s, "access", ACCESS, 1, ACCESS.removesuffix("+") + "{12}"),
                _pattern_spans(s, "hex", HEX.removesuffix("+") + "{32,}", 1, HEX.removesuffix("+") + "{32}"),
                _entropy(s, classes, allowed, window),
            )
        )

    return let(shadow, all_of)


def joined_spans(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, found`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``found`` is the array of ``secret_spans``, empty where there is nothing. Null text counts as empty. Rows with
    equal or null ids are scanned each by itself; an empty table gives no rows.
    """
    return docs.select("doc_id", secret_spans(F.col("text"), **options).alias("found"))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every stretch that ``spans`` (sorted by start) cover replaced by ``mask``; null stays null.

    Pieces between the stretches are read from parts of the text, so that none is reached from the text's start.
    """

    def gap(at: Column, x: Column) -> Column:
        fresh = (x["start"] > at) | (at < 0)
        piece = F.array(F.struct(F.greatest(at, F.lit(0).cast("long")).alias("start"), x["start"].alias("end")))
        more = F.when(fresh, piece).otherwise(F.array().cast(f"array<{PLACE}>"))
        return F.struct(F.greatest(at, x["end"]).alias("at"), more.alias("more"))

    def cut(parts: Column) -> Column:
        def read(g: Column) -> Column:
            first = F.floor(g["start"] / READ).cast("int")
            many = F.greatest(F.floor((g["end"] + READ - 1) / READ).cast("int") - first, F.lit(0))
            some = F.array_join(F.slice(parts, first + 1, many), "")
            return F.substring(some, (g["start"] - first * READ).cast("int") + 1, (g["end"] - g["start"]).cast("int"))

        size = F.lit(READ).cast("long") * F.size(parts)
        last = F.struct(F.array_max(F.transform(spans, lambda x: x["end"])).alias("start"), size.alias("end"))
        gaps = F.concat(running(spans, F.lit(-1).cast("long"), PLACE, gap), F.array(last))
        return F.array_join(F.transform(gaps, read), mask)

    masked = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{READ}}}"), F.lit(0)), cut)
    return F.when(F.size(spans) == 0, text).otherwise(masked)
