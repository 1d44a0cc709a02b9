"""Quality rules: base text rules and a target-against-raw likelihood ratio of hashed n-grams.

Everything runs as DataFrame expressions; there is no Python on the executors.

The method. Word unigrams and bigrams are hashed into ``buckets`` bins. Two multinomials over the bins
are counted: one from the trusted target documents, one from *all* documents of the corpus. A document's
score is the mean, over its n-grams, of ``log p_target(bin) - log p_raw(bin)`` (add-``alpha`` smoothing),
so that its length does not matter. A document is kept when its score reaches the cut: either ``threshold``, or,
where that is None, a low quantile of the trusted documents' own scores, worked out anew from the two tables
(``trusted_cut``); the verdict depends on nothing but the two tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import let, materialise, words

BUCKETS = 10_000
ALPHA = 0.5
#: Kept: a mean log likelihood ratio of at least this many nats an n-gram.
THRESHOLD = -0.1
#: Without a fixed threshold: so many of the trusted documents that pass the base rules lie below the cut.
CUT_SHARE = 0.01
WINDOW = 8
#: Bits that say which hashes of ids are trusted ones' (2 MB).
SLOTS = 1 << 24
SYMBOLS = "#*$%&|<>"
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]


def _with_hashes(text: Column, body) -> Column:
    """``body(words, unigram hashes, bigram hashes)`` of one text, each array computed once."""

    def pairs(h: Column) -> Column:
        two = F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))
        return F.when(F.size(h) > 1, two).otherwise(F.array().cast("array<bigint>"))

    return let(
        words(text),
        lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(pairs(h), lambda p: body(w, h, p))),
    )


def repeated_words(pairs: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words found twice or more in the same text, first finds included.

    ``pairs`` are the hashes of the text's bigrams; ``window`` is even.
    """

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        )

    def covered(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        twice = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: F.coalesce((at(i) == at(i - 1)) & (i > 0), F.lit(False))
            | F.coalesce(at(i) == at(i + 1), F.lit(False)),
        )
        starts = F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, x: F.struct(
                (acc["n"] + window - F.greatest(F.lit(0), acc["end"] - x)).alias("n"), (x + window).alias("end")
            ),
            lambda acc: acc["n"],
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(pairs) + 1 - window),
        lambda i: F.xxhash64(*[F.get(pairs, i + k) for k in range(0, window, 2)]),
    )
    return F.when(F.size(pairs) < window, F.lit(0)).otherwise(let(windows, of_windows)).cast("long")


def base_counts(text: Column, words_: Column, pairs: Column) -> dict[str, Column]:
    """The counts of the base rules of one text, given its words and the hashes of its bigrams."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = text
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    return {
        "n_words": F.size(words_).cast("long"),
        "word_chars": F.length(F.array_join(words_, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(plain)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(pairs),
    }


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Ids of all documents labelled good and not toxic; at most ``most`` of them, chosen by hashed id, if that is given."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    ids = good.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    return ids if most is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def trusted_texts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text of every row of ``docs`` whose id is in ``trusted`` (distinct ids).

    Texts whose id hashes to no trusted one stay where they are: one bit a hash value, ``SLOTS`` in all whatever the number of
    ids, is sent to the texts. The rest meet the ids in a join that keeps the ids of a part in memory and sorts no texts.
    """
    ids = trusted.select(F.col(trusted.columns[0]).cast(docs.schema[id_col].dataType).alias("_id")).distinct()
    slot = F.pmod(F.xxhash64("_id"), F.lit(SLOTS))
    longs = ids.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits"))
    every = docs.sparkSession.range(SLOTS // 64).select(F.col("id").alias("at")).join(longs, "at", "left")
    bits = every.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("s"))
    held = F.getbit(F.get(bits.select(F.col("s.bits")).scalar(), F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int"))
    likely = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(held == 1)
    return likely.join(ids.hint("shuffle_hash"), "_id", "left_semi").select("text")


def _bin_counts(texts: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bin_counts`` of the texts of all documents and of the trusted ones."""
    counts = []
    for df, name in ((texts, "raw"), (target, "target")):
        hashes = df.select(F.explode(_with_hashes(F.col("text"), lambda w, h, p: F.concat(h, p))).alias("hash"))
        counts.append(hashes.groupBy(F.pmod("hash", F.lit(buckets)).cast("int").alias("bin")).agg(F.count("*").alias(name)))
    every = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts[0], "bin", "left").join(counts[1], "bin", "left").agg(
        F.sort_array(
            F.collect_list(F.struct("bin", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))
        ).alias("c"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("n_target"),
    )


def bin_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: ``c``, the raw and target counts of every bin in order, and their sums ``n_raw`` and ``n_target``.

    Raw counts cover all of ``docs``; target counts cover those whose id is in ``trusted``.
    """
    return _bin_counts(docs.select(F.col(text_col).alias("text")), trusted_texts(docs, trusted, id_col, text_col), buckets)


def ratio_weights(counts: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """One row, one array: the log likelihood ratio of every bin. Without trusted documents every weight is 0."""
    ratio = F.transform(
        "c",
        lambda x: F.log((x["target"] + alpha) / (F.col("n_target") + alpha * buckets))
        - F.log((x["raw"] + alpha) / (F.col("n_raw") + alpha * buckets)),
    )
    zero = F.array_repeat(F.lit(0.0), buckets)
    return counts.select(F.when(F.col("n_target") > 0, ratio).otherwise(zero).alias("weights"))


def ratio_score(hashes: Column, pairs: Column, weights: Column, buckets: int = BUCKETS) -> Column:
    """Mean weight of the unigrams and bigrams with these hashes; 0 if there are none."""
    n = F.size(hashes) + F.size(pairs)
    add = lambda acc, x: acc + F.get(weights, F.pmod(x, F.lit(buckets)).cast("int"))
    total = F.aggregate(pairs, F.aggregate(hashes, F.lit(0.0), add), add)
    return F.when(n == 0, F.lit(0.0)).otherwise(total / n)


def own_score(
    hashes: Column, pairs: Column, target: Column, raw_log: Column, scale: tuple[int, int], buckets: int = BUCKETS, alpha: float = ALPHA
) -> Column:
    """``ratio_score`` of a trusted document as if it were not trusted: its own n-grams are taken out of the target.

    Scored with its own n-grams in the target, a trusted document lies above others of the same quality, the more so
    the smaller the corpus. Of every bin, ``target`` holds the count and ``raw_log`` the logarithm of the smoothed raw
    count; ``scale`` is the sums of raw and target counts.
    """
    n = F.size(hashes) + F.size(pairs)
    bins = F.sort_array(F.transform(F.concat(hashes, pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int")))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("bin"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        of_run = acc["n"] * (F.log(F.get(target, acc["bin"]) - acc["n"] + alpha) - F.get(raw_log, acc["bin"]))
        return F.when(x == acc["bin"], F.struct(acc["sum"].alias("sum"), x.alias("bin"), (acc["n"] + 1).alias("n"))).otherwise(
            F.struct((acc["sum"] + F.when(acc["n"] > 0, of_run).otherwise(0.0)).alias("sum"), x.alias("bin"), F.lit(1).alias("n"))
        )

    # a last bin that is none closes the last run
    total = F.aggregate(F.concat(bins, F.array(F.lit(-2))), zero, step, lambda acc: acc["sum"])
    sums = math.log(scale[0] + alpha * buckets) - F.log(scale[1] - n + alpha * buckets)
    return F.when(n == 0, F.lit(0.0)).otherwise(total / n + sums)


def _base_failed(c: Column) -> Column:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def trusted_cut(docs: DataFrame, trusted: DataFrame, counts: DataFrame, buckets: int = BUCKETS, share: float = CUT_SHARE) -> float:
    """The quantile ``share`` of ``own_score`` over all trusted documents that pass the base rules.

    The exact quantile, read from the two scores beside it in order. If there are no such documents, every score passes.
    """
    return _cut(trusted_texts(docs, trusted), counts, buckets, share)


def _cut(texts: DataFrame, counts: DataFrame, buckets: int, share: float = CUT_SHARE) -> float:
    """``trusted_cut`` of the texts of the trusted documents."""
    # the scores are written before any filter, which Spark would work out below the join as well, for other documents too
    ready = texts.select(
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
        counts.select(F.col("c.target")).scalar().alias("_target"),
        counts.select(F.transform("c.raw", lambda x: F.log(x + ALPHA))).scalar().alias("_raw_log"),
    )
    scale = counts.select("n_raw", "n_target").first()

    def judged(w: Column, h: Column, p: Column) -> Column:
        score = own_score(h, p, F.col("_target"), F.col("_raw_log"), tuple(scale), buckets)
        return let(F.struct(*[c.alias(name) for name, c in base_counts(F.col("_text"), w, p).items()]), lambda c: F.when(~_base_failed(c), score))

    own = materialise(ready.select(_with_hashes(F.col("_text"), judged).alias("own")), "trusted-scores").filter("own is not null")
    n = own.count()
    if not n:
        return -math.inf
    at = (n - 1) * share
    low = math.floor(at)
    beside = [r["own"] for r in own.orderBy("own").offset(low).limit(2).collect()]
    return beside[0] if low == at else (low + 1 - at) * beside[0] + (at - low) * beside[1]


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float | None = THRESHOLD,
    buckets: int = BUCKETS,
    target_docs: int | None = None,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Rules and verdict for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Columns: those in ``keep``, ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of
    ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words``,
    ``base_failed``, ``llr`` (nats an n-gram) and ``kept``.

    Null text counts as empty: no words, ``base_failed``. Rows with equal or null ids are judged each by
    itself. An empty ``labels`` gives ``llr`` 0 and leaves the base rules; an empty ``docs`` gives no rows.
    Repeated windows are compared by 64-bit hashes inside one document. With ``threshold`` None the n-grams are counted
    and the cut is worked out at once, when this function is called.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    trusted = trusted_ids(labels, target_docs)
    target = trusted_texts(docs, trusted)
    if threshold is None:
        # read twice, for counts and cut
        target = materialise(target, "trusted-texts")
    counts = _bin_counts(docs.select("text"), target, buckets)
    if threshold is None:
        # one row of ``buckets`` bins, counted once for cut and weights
        counts = docs.sparkSession.createDataFrame(counts.collect(), counts.schema)
        threshold = _cut(target, counts, buckets)
    weights = ratio_weights(counts, buckets).scalar()

    def judged(w: Column, h: Column, p: Column) -> Column:
        counts = base_counts(text, w, p) | {"llr": ratio_score(h, p, F.col("_weights"), buckets)}
        return let(F.struct(*[c.alias(name) for name, c in counts.items()]), with_verdict)

    def with_verdict(c: Column) -> Column:
        failed = _base_failed(c)
        kept = ~failed & (c["llr"] >= threshold)
        return F.struct(*[c[x].alias(x) for x in RULES], failed.alias("base_failed"), kept.alias("kept"))

    # one expression holds rules and verdict, so that a filter on the verdict works them out once
    ready = docs.select(*keep, F.col("text").alias("_text"), weights.alias("_weights"))
    return ready.select(*keep, _with_hashes(text, judged).alias("_r")).select(*keep, "_r.*")
