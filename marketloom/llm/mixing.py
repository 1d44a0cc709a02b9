"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` documents. In a period every source gives as many blocks as it has
parts, or what it has left. Among ``q`` slots of a period, a source with ``p`` parts gives its block ``i`` of the period
the release time ``floor(i * q / p)`` and the deadline ``ceil((i + 1) * q / p)``; every slot takes the released block with
the earliest deadline. At every slot, each source then deviates from ``slot * p / q`` by less than one block, and at a
period's end by nothing. A source without blocks is no part of the periods that follow. Nothing is dropped or repeated.

Sources with the same number of parts are alike. So the driver counts only how many there are for each number of parts
and blocks, which grows with the square root of the documents; alike periods are scheduled once; and every row finds its
slot by arithmetic from its source's rank among its like. Neither sources nor slots are listed on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.common import materialise

BLOCK_ROWS = 16
#: Rows that are numbered by one task, about.
BUCKET_ROWS = 65_536
#: A bucket of so many times that is dealt out again, row by row: it holds rows without an id, or of one id.
HOT_BUCKET = 4
NO_SOURCE = "(none)"
#: Parts of the mix of the registered query and of the pipeline; sources not named have one part.
PARTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2}


def period(alike: Mapping[int, int]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """One period of ``alike[p]`` sources with ``p`` parts each, earliest deadline first.

    For every number of parts and block of the period the runs of slots that its sources take, by rank: first rank,
    first slot, and how many. A run ends where a block with an earlier deadline is released.
    """
    q = sum(p * n for p, n in alike.items())
    future = [(0, p, 0) for p, n in alike.items() if n]
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(future)
    runs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    used: dict[tuple[int, int], int] = {}
    t = 0
    while t < q:
        while future and future[0][0] <= t:
            _, p, i = heapq.heappop(future)
            heapq.heappush(ready, (-(-(i + 1) * q // p), p, i))
            if i + 1 < p:
                heapq.heappush(future, ((i + 1) * q // p, p, i + 1))
        _, p, i = ready[0]
        done = used.get((p, i), 0)
        many = min(alike[p] - done, future[0][0] - t if future else q - t)
        runs.setdefault((p, i), []).append((done, t, many))
        used[p, i] = done + many
        t += many
        if used[p, i] == alike[p]:
            heapq.heappop(ready)
    return runs


class Schedule:
    """Slots of all blocks, from how many sources there are for each number of parts and of blocks.

    Periods follow one another in stretches of alike ones; ``self.first`` has each stretch's first period, ``self.base``
    that one's first slot, ``self.length`` the slots of a period, and ``self.kind`` the period's schedule.
    """

    def __init__(self, sizes: Mapping[tuple[int, int], int]):
        change: dict[int, dict[int, int]] = {0: {}}  # how many more sources with p parts there are from a period on
        lasts: dict[int, list[tuple[int, int]]] = {}
        for (p, blocks), n in sizes.items():
            full, rest = divmod(blocks, p)
            lasts.setdefault(p, []).append((full, n))
            for at, parts, more in ((0, p, n), (full, p, -n), (full, rest, n), (full + 1, rest, -n)):
                if parts:
                    here = change.setdefault(at, {})
                    here[parts] = here.get(parts, 0) + more
        starts = sorted(change)
        stretches, runs = [], []
        known: dict[tuple, int] = {}
        now: dict[int, int] = {}
        base = 0
        for at, after in zip(starts, [*starts[1:], starts[-1]]):
            for p, n in change[at].items():
                now[p] = now.get(p, 0) + n
            alike = {p: n for p, n in now.items() if n}
            key, q = tuple(sorted(alike.items())), sum(p * n for p, n in alike.items())
            if key not in known:
                known[key] = len(known)
                runs += [(known[key], p, i, *run) for (p, i), found in period(alike).items() for run in found]
            stretches.append((at, base, q, known[key]))
            base += q * (after - at)
        self.first, self.base, self.length, self.kind = np.array(stretches, np.int64).T
        kind, parts, i, self.rank, self.slot, _ = np.array(sorted(runs), np.int64).reshape(-1, 6).T
        # a group is a kind, a number of parts and a block of the period; those of a kind and number lie together
        self.most_parts, self.most_rank = 1 + int(parts.max(initial=0)), 1 + int(self.rank.max(initial=0))
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (parts[1:] != parts[:-1]) | (i[1:] != i[:-1])
        group = np.cumsum(new) - 1
        first = new & (i == 0)
        self.pair, self.group = (kind * self.most_parts + parts)[first], group[first]
        self.key = group * self.most_rank + self.rank
        self.lasts = {}
        for p, found in lasts.items():
            at, n = np.array(sorted(found), np.int64).T
            self.lasts[p] = at, np.concatenate([np.cumsum(n[::-1])[::-1], [0]])

    def _whole(self, parts: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How many sources of so many parts give all of them in a period."""
        out = np.zeros(len(parts), np.int64)
        for p in np.unique(parts):
            if p in self.lasts:
                at, beyond = self.lasts[p]
                mine = parts == p
                out[mine] = beyond[np.searchsorted(at, number[mine], "right")]
        return out

    def slots(self, parts: np.ndarray, blocks: np.ndarray, rank: np.ndarray, place: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The slot of each ``block`` of a source with ``parts`` and ``blocks`` in all.

        ``rank`` is the source's place among those of its parts, most whole periods first; ``place`` that among the
        sources which have as much left in the same last period.
        """
        number, i = np.divmod(block, parts)
        whole = number < blocks // parts
        mine = np.where(whole, parts, blocks % parts)
        among = np.where(whole, rank, self._whole(mine, number) + place)
        at = np.searchsorted(self.first, number, "right") - 1
        group = self.group[np.searchsorted(self.pair, self.kind[at] * self.most_parts + mine)] + i
        run = np.searchsorted(self.key, group * self.most_rank + np.minimum(among, self.most_rank - 1), "right") - 1
        return self.base[at] + (number - self.first[at]) * self.length[at] + self.slot[run] + among - self.rank[run]


def _weights(spark: SparkSession, parts: Mapping[str, int], common: int) -> DataFrame:
    """``_source, _named``: one row for each source that has a weight of its own."""
    rows = pd.DataFrame({"_source": list(parts), "_named": [p // common for p in parts.values()]})
    return spark.createDataFrame(rows, "_source string, _named long")


def _ranked(sources: DataFrame, group: list[str], order: list[Column], buckets: int, name: str) -> DataFrame:
    """``name``: the place of each source in its group, in ``order``, then in that of hashes.

    Sources are numbered in hash buckets with offsets, so that a group of any size is no task's alone. What stands in
    ``order`` takes few values.
    """
    ordered = sources.withColumns({f"_o{i}": c for i, c in enumerate(order)}).withColumn("_b", F.pmod(F.xxhash64("_source"), F.lit(buckets)))
    keys = [*group, *(f"_o{i}" for i in range(len(order))), "_b"]
    sizes = ordered.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy(*keys[len(group) :]).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("_source")) - 1
    return ordered.withColumn("_i", number).join(offsets, keys).withColumn(name, F.col("_before") + F.col("_i")).drop(*keys[len(group) :], "_before", "_i")


def mix_sources(
    docs: DataFrame,
    parts: Mapping[str, int],
    default_parts: int = 1,
    block_rows: int = BLOCK_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All rows and columns of ``docs`` (``doc_id``, ``source``) with ``block``, ``slot`` and ``in_block``.

    ``slot`` is the place of the row's block in the mixed stream, ``in_block`` its place in the block; sorting by both
    gives the stream. Blocks are filled in the order of hashed ids. ``parts`` holds positive whole weights; sources
    not named there get ``default_parts``. Rows without a source form one of their own (``(none)``). Rows of equal or
    null ids are numbered one after the other; an empty table gives no rows. Columns of ``docs`` named as the new ones
    are replaced, all others stay as they are, whatever their names. The named weights are a table that is joined; sources
    that are not named may be any number.

    Rows and sources are numbered in hash buckets with offsets, more of them the more there are, so that none is handled
    by one task. Where a bucket is filled by rows without an id or of one id, all rows are written with a number of their
    own first, and buckets are dealt by that too.
    """
    if default_parts < 1 or any(p < 1 or p != int(p) for p in parts.values()):
        raise ValueError("weights are positive whole parts")
    common = reduce(gcd, parts.values(), default_parts)
    spark = docs.sparkSession
    rows = docs.count()
    buckets = max(64, 1 << (rows // bucket_rows).bit_length())
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns if c not in ("block", "slot", "in_block")]

    def dealt(df: DataFrame, row: Column, own: list[str]) -> DataFrame:
        """The row's columns as one, beside the names used here."""
        hashed = F.xxhash64("doc_id", *own)
        bucket = F.pmod(F.xxhash64("doc_id", *own, F.lit("bucket")), F.lit(buckets)).cast("int")
        return df.select(row.alias("_row"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("_source"), hashed.alias("_hash"), bucket.alias("_bucket"), F.col("doc_id").alias("_id"))

    row = F.struct(*quoted)
    keyed = dealt(docs, row, [])
    sizes = keyed.groupBy("_source", "_bucket").agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > HOT_BUCKET * bucket_rows:
        numbered = materialise(docs.select(row.alias("_row"), "source", "doc_id", F.monotonically_increasing_id().alias("_own")), "mixing")
        keyed = dealt(numbered, F.col("_row"), ["_own"])
        sizes = keyed.groupBy("_source", "_bucket").agg(F.count("*").alias("n"))
    weight = F.coalesce("_named", F.lit(default_parts // common).cast("long"))
    sources = sizes.groupBy("_source").agg(F.sum("n").alias("n"))
    sources = sources.join(_weights(spark, parts, common), "_source", "left").select("_source", F.ceil(F.col("n") / block_rows).alias("_blocks"), weight.alias("_parts"))
    alike = sources.groupBy("_parts", "_blocks").agg(F.count("*").alias("n")).collect()
    schedule = spark.sparkContext.broadcast(Schedule({(r["_parts"], r["_blocks"]): r["n"] for r in alike}))
    # one row a source: its place among those of its parts, and among those that have as much left in the same last period
    several = 1 << (sum(r["n"] for r in alike) // bucket_rows).bit_length()
    left = sources.withColumns({"_whole": F.floor(F.col("_blocks") / F.col("_parts")), "_rest": F.col("_blocks") % F.col("_parts")})
    ranked = _ranked(_ranked(left, ["_parts"], [-F.col("_whole")], several, "_rank"), ["_whole", "_rest"], [F.col("_parts")], several, "_place")

    @F.pandas_udf("long")
    def slot(parts: pd.Series, blocks: pd.Series, rank: pd.Series, place: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series(schedule.value.slots(*(x.to_numpy(np.int64) for x in (parts, blocks, rank, place, block))))

    before = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")).join(ranked, "_source")
    number = F.row_number().over(W.partitionBy("_source", "_bucket").orderBy("_hash", "_id")) - 1
    numbered = keyed.withColumn("_n", number).join(offsets, ["_source", "_bucket"]).withColumn("_n", F.col("_n") + F.col("_offset"))
    blocked = numbered.withColumn("_block", F.floor(F.col("_n") / block_rows))
    return blocked.select(
        *(F.col(f"_row.{c}") for c in quoted),
        F.col("_block").alias("block"),
        slot("_parts", "_blocks", "_rank", "_place", "_block").alias("slot"),
        (F.col("_n") % block_rows).cast("int").alias("in_block"),
    )
