"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Every text becomes its set of hashed word n-grams. Texts with the same set form a class and are
   handled once, however many copies there are.
2. Band and row counts are chosen for a target recall at the threshold. Classes are shuffled on their band
   hashes; classes with a band hash in common form a bucket. Of buckets with the same members one is kept.
3. A bucket is cut into blocks of bounded size; each pair of blocks is one unit of work, in which the pairs are verified
   on the full sets by counting common n-grams with matrix products. A pair that shares several buckets counts in the
   first of them. Only counts of links and a spanning forest leave the task, never the pairs.
4. Components of the verified links are the groups of near duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.common import materialise
from marketloom.llm.components import components
from marketloom.llm.shingles import WordHashes, band_hashes, chosen_bands, set_digest, shingle_set

N = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9995
MOST_HASHES = 160
#: Bounds of a block: sets, and n-grams in all of them (a single larger set is a block of its own).
BLOCK_SETS, BLOCK_NGRAMS = 2048, 2_000_000
#: A class's buckets: band hash, number of blocks, and the class's own block.
MINE = "array<struct<band:bigint,nb:int,block:int>>"


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, size, node, bands``: the size and digest of each text's n-gram set and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, n, memo) for t in part.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                found = iter([h.view(np.int64) for h in band_hashes(full, bands, rows)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "size", "node", "bands"],
                )

    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text)
    return source.mapInArrow(run, "doc_id long, text_hash long, size long, node binary, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, n, memo) for t in part.column("text").to_pylist()]
                same = pa.array([set_digest(s) == d for s, d in zip(sets, part.column("node").to_pylist(), strict=True)])
                rest = part.drop_columns(["text"]).append_column("ngrams", pa.array([s.tobytes() for s in sets], pa.binary()))
                yield rest.filter(same)

    return docs.mapInArrow(run, f"node binary, copies long, mine {MINE}, ngrams binary")


def common_counts(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of each of the first ``split`` sets (all, if 0) with each of the others (all)."""
    k = len(sets)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    spread = np.bincount(column)
    order = np.argsort(column, kind="stable")
    row, starts = row[order], np.cumsum(spread) - spread
    counts = np.zeros((k, k), np.float32)
    sparse = (spread > 1) & (spread <= max(2, k // 16))
    for d in np.unique(spread[sparse]):
        at = starts[sparse & (spread == d)]
        step = max(1, 1_000_000 // int(d * d))
        for i in range(0, len(at), step):
            members = row[at[i : i + step, None] + np.arange(d)]
            np.add.at(counts, (np.repeat(members, d, axis=1), np.tile(members, (1, d))), 1)
    dense = np.flatnonzero((spread > 1) & ~sparse)
    for i in range(0, len(dense), 1024):
        some = dense[i : i + 1024]
        here = np.zeros((len(some), k), np.float32)
        for j, c in enumerate(some):
            here[j, row[starts[c] : starts[c] + spread[c]]] = 1
        counts += here.T @ here
    return counts[:split, split:] if split else counts


def _linked(sets: list[np.ndarray], split: int, threshold: Fraction) -> np.ndarray:
    """Which pairs reach the threshold; without a split, the diagonal is False."""
    size = np.array([len(s) for s in sets], np.int64)
    common = common_counts(sets, split).astype(np.int64)
    total = (size[:split, None] + size[None, split:]) if split else (size[:, None] + size[None, :])
    near = (threshold.numerator + threshold.denominator) * common >= threshold.numerator * total
    if not split:
        np.fill_diagonal(near, False)
    return near


def _roots(near: np.ndarray, split: int) -> np.ndarray:
    """The smallest index of each set's component, all sets of both blocks counted through."""
    if not split:
        label = np.arange(len(near))
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
            least = least[least]
            if (least == label).all():
                return label
            label = least
    a, b = near.shape
    label = np.arange(a + b)
    while True:
        left = np.minimum(label[:a], np.where(near, label[None, a:], a + b).min(axis=1, initial=a + b))
        right = np.minimum(label[a:], np.where(near, left[:, None], a + b).min(axis=0, initial=a + b))
        least = np.concatenate([left, right])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _seen(rows: list[dict], band: int, split: int) -> np.ndarray:
    """Which pairs share a bucket before ``band``, where they count."""
    members: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for b in r["mine"]:
            if b["band"] < band:
                members.setdefault(b["band"], []).append(i)
    seen = np.zeros((len(rows), len(rows)), bool)
    for some in members.values():
        seen[np.ix_(some, some)] = True
    return seen[:split, split:] if split else seen


def _verified(blocks: DataFrame, threshold: Fraction) -> DataFrame:
    """``node, other, links``: for each set of a pair of blocks, its root there and its number of linked documents."""

    def decide(rows: list[dict], band: int, lo: int, hi: int) -> pa.RecordBatch | None:
        rows = list({r["node"]: r for r in rows}.values())
        own = {r["node"]: next(b["block"] for b in r["mine"] if b["band"] == band) for r in rows}
        if lo != hi:
            rows.sort(key=lambda r: own[r["node"]])
        split = sum(own[r["node"]] == lo for r in rows) if lo != hi else 0
        if len(rows) < 2 or lo != hi and split in (0, len(rows)):
            return None
        seen = _seen(rows, band, split)
        if seen.all():
            return None
        near = _linked([r["ngrams"] for r in rows], split, threshold) & ~seen
        copies = np.array([r["copies"] for r in rows], np.int64)
        if split:
            links = np.concatenate([near @ copies[split:], near.T @ copies[:split]])
        else:
            links = near @ copies
        root = _roots(near, split)
        keep = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i]["node"] for i in keep], pa.binary()),
                pa.array([rows[root[i]]["node"] for i in keep], pa.binary()),
                pa.array(links[keep], pa.int64()),
            ],
            ["node", "other", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "lo", "hi")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows]) if batch.num_rows else ():
                here = tuple(keys[:, at].tolist())
                if here != key:
                    if rows and (out := decide(rows, *key)) is not None:
                        yield out
                    key, rows = here, []
                # only these rows become Python objects; their n-grams stay where the batch has them
                part = batch.slice(at, end - at)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("ngrams")]
                values = zip(*(part.column(c).to_pylist() for c in ("node", "copies", "mine")), sets, strict=True)
                rows += [dict(zip(("node", "copies", "mine", "ngrams"), v)) for v in values]
        if rows and (out := decide(rows, *key)) is not None:
            yield out

    dealt = blocks.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    return dealt.mapInArrow(run, "node binary, other binary, links long")


def near_duplicates(
    docs: DataFrame,
    n: int = N,
    threshold: Fraction = THRESHOLD,
    recall: float = RECALL,
    most_hashes: int = MOST_HASHES,
) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``; other columns are ignored):

    * ``doc_id``, and ``text_hash``, which tells rows of the same id apart;
    * ``n_ngrams``, the size of its set;
    * ``class_id``, the smallest id of the documents with the same set;
    * ``group_id``, the smallest id of its group of near duplicates (links, followed through);
    * ``n_links``, the number of other documents with a similarity of ``threshold`` or more;
    * ``stays``, whether its id and text hash are the smallest of its group.

    Words are compared unchanged. A text of fewer than ``n`` words is one n-gram; a null, empty or blank one has
    none and is alone. Rows without an id take no part: they keep null ids and 0 links, and stay. Repeated rows are
    copies of one another. An empty table gives no rows. N-grams are compared by 64-bit hashes.
    """
    bands, rows = chosen_bands(float(threshold), recall, most_hashes)
    sig = materialise(signatures(docs, n, bands, rows), "signatures")
    known = sig.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("head"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    banded = classes.select("node", "size", F.explode("bands").alias("band"))
    # members told by two 64-bit hashes: buckets with the same ones would verify the same pairs
    fingers = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"f{k}") for k in (0, 1)]
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("ngrams"), *fingers).filter("n > 1")
    once = buckets.groupBy("n", "f0", "f1").agg(F.min("band").alias("band"), F.first("ngrams").alias("ngrams"))
    nb = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("ngrams") / BLOCK_NGRAMS)).cast("int")
    dealt = banded.join(once.select("band", nb.alias("nb")), "band")
    own = F.struct("band", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("block"))
    mine = dealt.groupBy("node").agg(F.collect_list(own).alias("mine"))  # as many as bands at most

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # written first, so that the size of its ids is known: Spark broadcasts them if they are few, and the texts that no bucket
    # holds are not shuffled; if they are many, both joins share one shuffle of the texts
    asked = materialise(mine.join(classes.select("node", "copies", "head.*"), "node"), "asked")
    key = ["doc_id", "text_hash"]
    held = texts.join(asked.select(key), key, "left_semi").join(asked.hint("merge"), key)
    # rows that repeat id and text are one, as they come sorted by both out of the join
    once = held.withColumn("_again", F.row_number().over(W.partitionBy(key).orderBy(key))).filter("_again = 1")
    sets = _sets(once.select("text", "node", "copies", "mine"), n)
    placed = sets.select("node", "copies", "mine", "ngrams", F.explode("mine").alias("at"))
    pairs = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("at.nb") - 1))).select(
        "at.band", F.least("at.block", "with").alias("lo"), F.greatest("at.block", "with").alias("hi"), "node", "copies", "mine", "ngrams"
    )
    links = materialise(_verified(pairs, threshold), "links")
    groups = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), "groups")

    members = classes.select("node", "head", "copies").join(groups, "node", "left")
    members = members.withColumn("root", F.coalesce("root", "node"))
    least = members.groupBy("root").agg(F.min("head").alias("group"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = (
        members.join(least, "root")
        .join(counted, "node", "left")
        .select("node", F.col("head.doc_id").alias("class_id"), "group", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    found = sig.join(per_class, "node", "left")
    has_id = F.col("doc_id").isNotNull()
    return found.select(
        "doc_id",
        "text_hash",
        F.col("size").alias("n_ngrams"),
        F.when(has_id, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(has_id, F.coalesce("group.doc_id", "doc_id")).alias("group_id"),
        F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(~has_id | (F.struct("doc_id", "text_hash") == F.col("group")), F.lit(True)).alias("stays"),
    )
