"""Substring dedup: word windows that also start in a document of smaller id, merged into removal intervals.

Windows of ``width`` words are hashed by Rabin-Karp (prefix sums of a polynomial, two lanes of 64 bits) and counted in
Spark: the smallest document of a window decides for all others. Three levels keep the shuffles small without losing
a window:

1. *Chunks.* A text is cut where a hash of a few words says so; a chunk is hashed with the ``width - 1`` words after
   it, so equal chunks start equal windows. A chunk that a smaller document holds settles all its windows at once, and
   these windows need not be counted again: the smaller document's own do that.
2. *Anchors.* Every window left names its smallest hash of a few words. Equal windows name the same one, so a window
   whose anchor is found in one document only is unique.
3. *Windows.* The rest are counted by their hashes.

Each batch of documents is counted before it is shuffled: for a key, only the batch's smallest document goes to the
key's task; what repeats within the batch is known at once and is dealt by document. So a passage in a third of all
documents sends one row a batch to its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.common import materialise, typed
from marketloom.llm.shingles import mixed, rolling

WIDTH = 13
GRAM = 3
CHUNK = 24
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xDA942042E4DD58B5)
#: Bytes of text that are hashed together; a longer text is handled by itself.
ROOM = 262_144
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = np.random.default_rng(7).integers(1, 2**63, (2, 256), dtype=np.uint64)


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
            self.up, self.down = steps(self.base), steps(self.inverse)
        return self.up[:n], self.down[:n]


POWERS = [Powers(b) for b in BASES]


def prefix_sums(values: np.ndarray, powers: Powers) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Rabin-Karp: a function that hashes ``values[start:end]`` for arrays of starts and ends."""
    up, down = powers.of(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down[:-1], dtype=np.uint64)])
    return lambda starts, ends: mixed((sums[ends] - sums[starts]) * up[starts])


class Windows:
    """Words, chunks, anchors and windows of some texts laid end to end; windows never cross texts.

    Windows are numbered through; ``text`` and ``place`` give each one's text and first word in it.
    """

    def __init__(self, texts: list[bytes], width: int):
        self.width = width
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        first = np.searchsorted(starts, offsets)  # first word of each text
        self.counts = np.diff(first)
        of_text = np.maximum(self.counts - width + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), of_text)
        self.first_window = np.cumsum(of_text) - of_text
        self.place = np.arange(of_text.sum()) - self.first_window[self.text]
        self.word = first[self.text] + self.place
        if not len(self.word):
            return
        # two hashes of every word, from different values and bases, one for each lane
        hashes = [prefix_sums(b[raw], p)(starts, ends) for b, p in zip(BYTES, POWERS[2:])]
        self.lanes = [prefix_sums(h, p) for h, p in zip(hashes, POWERS)]
        self.grams = mixed(rolling(hashes[0], GRAM))
        cut = self.grams[self.word] % np.uint64(CHUNK) == 0
        cut[self.place == 0] = True
        self.chunk_first = np.flatnonzero(cut)
        self.chunk_text = self.text[self.chunk_first]
        self.chunk_count = np.bincount(self.chunk_text, minlength=len(texts))
        self.chunk_base = np.cumsum(self.chunk_count) - self.chunk_count
        last = np.append(self.chunk_first[1:], len(self.word)) - 1
        self.chunk_hashes = self.hashed(self.word[self.chunk_first], self.word[last] + width)

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        return [lane(starts, ends).view(np.int64) for lane in self.lanes]

    def chunks(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Text, hashes and number in the text of every chunk."""
        return self.chunk_text, self.chunk_hashes, np.arange(len(self.chunk_first)) - self.chunk_base[self.chunk_text]

    def anchors(self) -> np.ndarray:
        """The smallest hash of ``GRAM`` words in each window."""
        least, have, need = self.grams, 1, self.width - GRAM + 1
        while have < need:
            step = min(have, need - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return least[self.word].view(np.int64)

    def open(self, settled: list[list[int] | None]) -> np.ndarray:
        """Which windows are in chunks that are not settled."""
        done = np.zeros(len(self.chunk_first), bool)
        for t, runs in enumerate(settled):
            if runs and self.chunk_count[t]:
                mine = slice(self.chunk_base[t], self.chunk_base[t] + self.chunk_count[t])
                done[mine] = alike([h[mine] for h in self.chunk_hashes], _unfolded(runs))
        return ~np.repeat(done, np.diff(np.append(self.chunk_first, len(self.word))))


def alike(hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Which places have the same hashes as one of the places ``at``: only one of a text's equal places is asked for."""
    order = np.lexsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    hit = np.zeros(len(order) + 1, bool)
    hit[group[at]] = True
    return hit[group]


def intervals(n_words: int, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words covered by the windows at these places, as starts and ends."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    covered = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])
    edge = np.diff(covered)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes], dict[str, list]]]:
    """Rows of a batch in groups of bounded size: their numbers, their texts, and their lists by column."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    lists = {c: batch.column(c).to_pylist() for c in ("chunk", "anchor", "at") if c in batch.schema.names}
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= ROOM):
            size += len(texts[end]) + 1
            end += 1
        yield np.arange(at, end), texts[at:end], {c: v[at:end] for c, v in lists.items()}
        at = end


#: A run of values is one number: the first value times RUN, and how many follow one another (less than RUN).
RUN = 4096


def _runs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and runs of the values that follow one another in a row."""
    new = np.ones(len(value), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1] + 1)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(value)))
    pieces = -(-length // (RUN - 1))  # long runs are cut
    at = np.repeat(start, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (RUN - 1)
    size = np.minimum(np.repeat(start + length, pieces) - at, RUN - 1)
    return row[at], value[at] * RUN + size


def _unfolded(runs: list[int] | None) -> np.ndarray:
    """All values of some runs."""
    if not runs:
        return np.empty(0, np.int64)
    first, size = np.divmod(np.asarray(runs, np.int64), RUN)
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _counted(rows: list[list[np.ndarray]], ids: np.ndarray, n_keys: int, shared: bool) -> tuple[np.ndarray, ...]:
    """Count a batch's rows (row of the batch, keys, value): what is known already, and what must be asked.

    The rows of each key's smallest document are asked for, once a text and key, with how much larger the batch's largest
    document with that key is. A row is known if a smaller document of the batch has its key; with ``shared``, if any
    other does. Known rows get their own document as key, so that they spread. But for ``shared``, values are runs, and
    known values that follow one another are one row.
    """
    row, *rest = (np.concatenate([r[k] for r in rows]) for k in range(len(rows[0])))
    keys, value = rest[:n_keys], rest[n_keys]
    doc = ids[row]
    order = np.lexsort((row, doc, *keys))
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    if len(new):
        new[0] = True
    group = np.cumsum(new) - 1
    sorted_doc, sorted_row = doc[order], row[order]
    starts = np.flatnonzero(new)
    least = sorted_doc[starts][group]
    most = sorted_doc[np.append(starts[1:], len(order)) - 1][group]
    known = np.empty(len(order), bool)
    known[order] = (least < most) if shared else (sorted_doc > least)
    first = new.copy()
    first[1:] |= sorted_row[1:] != sorted_row[:-1]
    ask = np.empty(len(order), bool)
    ask[order] = (sorted_doc == least) & first
    span = np.empty(len(order), np.int64)
    span[order] = most - least
    told, asked = np.flatnonzero(known), np.flatnonzero(ask)
    if shared:
        row_told, value_told, value_asked = row[told], value[told], value[asked]
    else:
        row_told, value_told = _runs(row[told], value[told])
        value_asked = value[asked] * RUN + 1
    flag = np.arange(len(row_told) + len(asked)) < len(row_told)
    own = ids[row_told]
    both = lambda a, b: np.concatenate([a, b])
    more = both(np.zeros(len(row_told), np.int64), span[asked])
    return both(row_told, row[asked]), flag, more, *(both(own, k[asked]) for k in keys), both(value_told, value_asked)


def _emit(docs: DataFrame, width: int, keys: list[str], value: str, make, shared: bool = False) -> DataFrame:
    """``doc_id, row, known, more``, keys and value of what ``make(windows, lists)`` gives: texts' numbers, keys, values."""
    names = [*keys, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for numbers, texts, lists in _groups(batch):
                w = Windows(texts, width)
                if len(w.word):
                    text, *columns = make(w, lists)
                    rows.append([numbers[text], *columns])
            if not rows:
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row, known, more, *columns = _counted(rows, ids, len(keys), shared)
            index = pa.array(row)
            own = [batch.column(c).take(index) for c in ("doc_id", "row")]
            columns = [*own, pa.array(known), pa.array(more), *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "known", "more", *names])

    return docs.mapInArrow(run, "doc_id long, row long, known boolean, more long, " + ", ".join(f"{c} long" for c in names))


def _lists(rows: DataFrame, column: str) -> DataFrame:
    """One row a text: its own values of ``column``."""
    return rows.groupBy("doc_id", "row").agg(F.collect_set(column).alias(column))


def _earlier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is also in a document of smaller id."""
    first = F.min("doc_id").over(W.partitionBy("known", *keys))
    return rows.withColumn("first", first).filter("known or doc_id > first")


def _folded(rows: DataFrame, column: str) -> DataFrame:
    """One row a text: its own runs of values, those that follow one another joined.

    Values are gathered by stretches of ``RUN`` first, so that a long text's are never in one set before they are runs.
    """
    by = ["doc_id", "row"]
    stretch = F.floor(F.col(column) / (RUN * RUN // 2)).alias("stretch")  # a run is shorter than RUN
    parts = rows.repartition(*by).groupBy(*by, stretch).agg(F.sort_array(F.collect_set(column)).alias("v"))
    single = lambda x: x % RUN == 1
    follows = lambda x, y: single(x) & single(y) & (x + RUN == y)
    starts = F.filter("v", lambda x, i: ~F.coalesce(follows(F.get("v", i - 1), x), F.lit(False)))
    ends = F.filter("v", lambda x, i: ~F.coalesce(follows(x, F.get("v", i + 1)), F.lit(False)))
    runs = parts.withColumn("v", F.zip_with(starts, ends, lambda a, b: a + F.floor((b - a) / RUN)))
    return runs.groupBy(*by).agg(F.flatten(F.collect_list("v")).alias(column))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For every row of ``docs`` (``doc_id``, ``text``; other columns are ignored):

    ``doc_id``, ``n_words``, ``n_removed``, ``starts`` and ``ends`` (the maximal intervals of removed words) and
    ``kept`` (the kept words, joined by one space).

    A word goes if a window of ``width`` words over it also starts in a document of smaller id; windows are judged on
    the input. Words are taken unchanged. Null and blank texts have no words; texts of fewer than ``width`` words lose
    none. Documents of equal id don't remove one another's words; a row without an id neither loses words nor makes
    others lose any. An empty table gives no rows. Windows are compared by 128 bits, which come from two hashes of every
    word; rows that repeat an id are told apart by a 64-bit hash of the text.
    """
    every = docs.select(typed(docs, "doc_id", "bigint"), F.xxhash64("text").alias("row"), typed(docs, "text", "string"))
    texts = every.filter(F.col("doc_id").isNotNull())

    def of_chunks(w: Windows, lists: dict) -> tuple:
        text, hashes, number = w.chunks()
        return text, *hashes, number

    settled = materialise(_folded(_earlier(_emit(texts, width, ["a", "b"], "chunk", of_chunks), ["a", "b"]), "chunk"), "chunks")

    key = ["doc_id", "row"]
    rest = texts.repartition(*key).join(settled, key, "left")  # one shuffle of the texts serves all that follows

    def of_anchors(w: Windows, lists: dict) -> tuple:
        at = np.flatnonzero(w.open(lists["chunk"]))
        text, anchor = w.text[at], w.anchors()[at]
        once = np.unique(np.column_stack([text, anchor]), axis=0) if len(at) else np.empty((0, 2), np.int64)
        return once[:, 0], once[:, 1], once[:, 1]

    anchors = _emit(rest, width, ["key"], "anchor", of_anchors, shared=True)
    both = W.partitionBy("known", "key")
    counted = anchors.withColumns({"first": F.min("doc_id").over(both), "last": F.max(F.col("doc_id") + F.col("more")).over(both)})
    shared = _lists(counted.filter("known or first < last"), "anchor")

    def of_windows(w: Windows, lists: dict) -> tuple:
        left, anchors = w.open(lists["chunk"]), w.anchors()
        for t, mine in enumerate(lists["anchor"]):
            at = slice(w.first_window[t], w.first_window[t] + max(0, w.counts[t] - width + 1))
            left[at] &= np.isin(anchors[at], np.asarray(mine or [], np.int64))
        at = np.flatnonzero(left)
        return w.text[at], *w.hashed(w.word[at], w.word[at] + width), w.place[at]

    repeated = _folded(_earlier(_emit(rest.join(shared, key), width, ["a", "b"], "at", of_windows), ["a", "b"]), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for numbers, texts, lists in _groups(batch):
                out = {k: [] for k in ("doc_id", "n_words", "n_removed", "starts", "ends", "kept")}
                touched = [t for t in range(len(texts)) if lists["chunk"][t] or lists["at"][t]]
                gone = {}
                if touched:
                    w = Windows([texts[t] for t in touched], width)
                    shut = ~w.open([lists["chunk"][t] for t in touched])
                    for k, t in enumerate(touched):
                        mine = slice(w.first_window[k], w.first_window[k] + max(0, w.counts[k] - width + 1))
                        if lists["at"][t]:
                            shut[mine] |= alike(w.hashed(w.word[mine], w.word[mine] + width), _unfolded(lists["at"][t]))
                        gone[t] = np.flatnonzero(shut[mine])
                for t, text in enumerate(texts):
                    words = text.split()
                    starts = ends = np.empty(0, np.int64)
                    if t in gone:
                        starts, ends = intervals(len(words), gone[t], width)
                    kept, before = [], 0
                    for s, e in zip(starts, ends, strict=True):
                        kept += words[before:s]
                        before = e
                    kept = kept + words[before:] if before else words
                    values = (ids[numbers[t]], len(words), int((ends - starts).sum()), starts, ends, b" ".join(kept).decode("utf-8", "surrogatepass"))
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    nameless = every.filter(F.col("doc_id").isNull())
    none = lambda c: F.lit(None).cast("array<long>").alias(c)
    last = rest.join(repeated, key, "left").select("doc_id", "text", "chunk", "at")
    schema = "doc_id long, n_words long, n_removed long, starts array<long>, ends array<long>, kept string"
    return last.unionByName(nameless.select("doc_id", "text", none("chunk"), none("at"))).mapInArrow(run, schema)
