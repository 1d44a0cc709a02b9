"""Alignment of two tokenizers by the bytes of their tokens.

Both encode a space and the text. The tokens of each lie side by side on the same bytes, which makes two sparse
matrices, tokens by bytes, in compressed rows (CSR) of our own:

* ``A B'``, by Gustavson's products of rows, has an entry for each two tokens that overlap: the links;
* places where tokens of both end cut the bytes into groups. The product of the incidences of tokens in groups has an
  entry for each two tokens of one group; as these can be many, only how many they are is worked out (the sizes of the
  product's rows).

How many documents hold a pair of ids linked is counted in Spark. Documents are handled in blocks of bounded size: a
block gives each distinct pair once, with its number of documents; the counts of a block's pairs come back to it by a
join; and the block's documents are then summed up by themselves. Nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from marketloom.llm.byte_pairs import json_codec
from marketloom.llm.common import materialise
from marketloom.llm.pieces import SPACE, groups

#: Bytes of text of a block (a longer text is a block by itself), and what a document counts for besides its text.
BLOCK_BYTES = 8 << 20
DOC_BYTES = 128
#: A pair of ids as one number.
ID_BITS = 24
DOC = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_group_links:bigint,groups_sha256:string,n_pairs:bigint>"


class CSR(NamedTuple):
    """A sparse matrix: row ``i`` has ``values[k]`` in column ``indices[k]``, for ``k`` from ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int


def spans(sizes: np.ndarray) -> CSR:
    """Tokens by bytes, of tokens that lie one after the other."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return CSR(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def members(group: np.ndarray, n_groups: int) -> CSR:
    """Tokens by groups."""
    return CSR(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), n_groups)


def transposed(m: CSR) -> CSR:
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    order = np.argsort(m.indices, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    return CSR(starts, rows[order], m.values[order], len(m.starts) - 1)


def row_terms(a: CSR, b: CSR) -> np.ndarray:
    """How many terms each row of ``a b`` has: its number of entries, if each row of ``a`` has one."""
    return np.add.reduceat(np.append(np.diff(b.starts)[a.indices], 0), a.starts[:-1]) if len(a.starts) > 1 else np.empty(0, np.int64)


def product(a: CSR, b: CSR) -> CSR:
    """``a b`` by Gustavson's rows: for every entry of a row of ``a``, the row of ``b`` that it names is added."""
    width = np.diff(b.starts)[a.indices]
    row = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), width)
    term = np.arange(width.sum()) + np.repeat(b.starts[a.indices] - np.cumsum(width) + width, width)
    key, value = row * b.columns + b.indices[term], np.repeat(a.values, width) * b.values[term]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    row, column = np.divmod(key[first], max(b.columns, 1))
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(a.starts) - 1))])
    return CSR(starts, column, np.add.reduceat(value, first) if len(first) else value, b.columns)


class Aligned(NamedTuple):
    """Documents one after the other: for each, its numbers; and the distinct linked pairs of each, with their links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_group_links: np.ndarray
    groups: list[bytes]
    n_pairs: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class Aligner:
    """Two tokenizers, and the bytes of their tokens."""

    def __init__(self, tokenizer_file: str, pattern: str, model_file: str):
        self.a = json_codec(tokenizer_file, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto.FromString(open(model_file, "rb").read())
        self.a_bytes = self.a.pairs.tokens
        # where every token is one that merging makes, ranks give the same ids, and tiktoken does this faster
        ranks = {t: i for i, t in enumerate(self.a_bytes) if t is not None}
        self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if len(self.a.pairs.parts) + 256 == len(ranks) else None
        self.sure: set[str] = set()
        self.b_bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.a_size, self.b_size = (np.array([len(t or b"") for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # ids as they are spelt: within and at the end of a group's part
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.spelt = [f"{i}{end}".encode() for k, end in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in range(k)]

    def encode_a(self, text: str) -> np.ndarray:
        """A's ids; by our own codec if the text has characters that an edition of Unicode may not know."""
        if self.ranked is None or not text.isascii() and not self._sure(text):
            return self.a.encode(text)
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def _sure(self, text: str) -> bool:
        new = set(text) - self.sure
        self.sure |= {c for c in new if unicodedata.category(c) != "Cn"}
        return new <= self.sure

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Both tokenizers' ids of each text; none where the bytes of either don't add up to a space and the text."""
        a, b = [], []
        for text, ids in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            data = b" " + text.encode() if text else b""
            if data and b"".join(map(self.b_bytes.__getitem__, ids)) == data:
                own = self.encode_a(" " + text)
                if self.a.decode(own.tolist()) == data:
                    a.append(own)
                    b.append(ids)
                    continue
            a.append(np.empty(0, np.int32))
            b.append([])
        return a, b

    def align(self, texts: list[str | None]) -> Aligned:
        a, b = self.encode(texts)
        n_a, n_b = (np.array([len(i) for i in ids], np.int64) for ids in (a, b))
        a, b = (np.concatenate([np.empty(0, np.int64), *(np.asarray(i, np.int64) for i in ids)]) for ids in (a, b))
        a_spans, b_spans = spans(self.a_size[a]), spans(self.b_size[b])
        a_ends, b_ends = a_spans.starts[1:], b_spans.starts[1:]
        links = product(a_spans, transposed(b_spans))
        # groups end where tokens of both do
        ends = np.zeros(a_spans.columns + 1, np.int8)
        ends[a_ends] += 1
        ends[b_ends] += 1
        common = np.flatnonzero(ends == 2)
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        in_groups = transposed(members(b_group, len(common)))
        group_links = row_terms(members(a_group, len(common)), in_groups)

        doc_of_a = np.repeat(np.arange(len(texts)), n_a)
        per_doc = lambda of, weights=None: np.bincount(of, weights, len(texts)).astype(np.int64)
        doc_of_group = np.repeat(np.arange(len(texts)), n_b)[in_groups.indices[in_groups.starts[:-1]]] if len(common) else np.empty(0, np.int64)
        doc_of_link = np.repeat(doc_of_a, np.diff(links.starts))
        pair = a[np.repeat(np.arange(len(a)), np.diff(links.starts))] << ID_BITS | b[links.indices]
        order = np.lexsort((pair, doc_of_link))
        pair, doc = pair[order], doc_of_link[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])) if len(pair) else np.empty(0, np.int64)
        return Aligned(
            n_a,
            n_b,
            per_doc(doc_of_group),
            per_doc(doc_of_link),
            per_doc(doc_of_a, group_links),
            self._written(a, b, a_group, b_group, np.isin(a_ends, common, assume_unique=True), np.isin(b_ends, common, assume_unique=True), n_a + n_b),
            per_doc(doc[first]),
            pair[first],
            np.diff(np.append(first, len(pair))),
        )

    def _written(self, a, b, a_group, b_group, a_last, b_last, sizes) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``: of every group first the ids of A, then those of B."""
        n = int(max(a_group.max(initial=-1), b_group.max(initial=-1))) + 1
        of_a, of_b = np.cumsum(np.bincount(a_group, minlength=n)), np.bincount(b_group, minlength=n)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[a_group]] = a + len(self.a_bytes) * a_last
        out[np.arange(len(b)) + of_a[b_group]] = b + 2 * len(self.a_bytes) + len(self.b_bytes) * b_last
        bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return [b"".join(map(self.spelt.__getitem__, out[s:e].tolist()))[:-1] for s, e in zip(bounds, bounds[1:])]


@lru_cache(maxsize=1)
def aligner(tokenizer_file: str, pattern: str, model_file: str) -> Aligner:
    return Aligner(tokenizer_file, pattern, model_file)


def blocks_of(docs: DataFrame, tokenizer_file: str, pattern: str, model_file: str) -> DataFrame:
    """``block, docs, pairs, held, at, times``: aligned documents in blocks.

    ``pairs`` are a block's distinct linked pairs and ``held`` how many of its documents hold each; ``at`` tells, for
    each document one after the other, where its pairs stand there (as differences, which take less room), and
    ``times`` how many links each of them has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = aligner(tokenizer_file, pattern, model_file)
        number = count(TaskContext.get().partitionId() << 32)
        rows: list[pa.StructArray] = []
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal size
            each = np.concatenate([np.empty(0, np.int64), *pairs])
            distinct, at, held = np.unique(each, return_inverse=True, return_counts=True)
            found = [distinct, held, np.diff(at, prepend=0), np.concatenate([np.empty(0, np.int64), *times])]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = [pa.concat_arrays(rows), *(pa.array(x, kind) for x, kind in zip(found, kinds))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns]
            for held_list in (rows, pairs, times):
                held_list.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([next(number)]), *lists], ["block", "docs", "pairs", "held", "at", "times"])

        for batch in batches:
            text = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
            for at, end in groups(sizes):
                more = sum(sizes[at:end]) + DOC_BYTES * (end - at)
                if rows and size + more > BLOCK_BYTES:
                    yield block()
                found = lines.align(text.slice(at, end - at).to_pylist())
                size += more
                digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found.groups], pa.string())
                numbers = [pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links, found.n_group_links)]
                rows.append(pa.StructArray.from_arrays([batch.column(0).slice(at, end - at), *numbers, digests, pa.array(found.n_pairs)], names))
                pairs.append(found.pairs)
                times.append(found.times)
        if rows:
            yield block()

    names = [f.split(":")[0] for f in DOC[7:-1].split(",")]
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, f"block long, docs array<{DOC}>, pairs array<long>, held array<int>, at array<int>, times array<int>")


def align_tokenizers(docs: DataFrame, tokenizer_file: str, pattern: str, model_file: str) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``; other columns are ignored):

    ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_group_links``, ``n_best``, ``count_sum`` and
    ``groups_sha256``.

    A is a byte-level BPE (a tokenizer's JSON file) of a space and the text, B a sentencepiece model of the text. A
    pair's count is the number of documents that hold it linked; ``count_sum`` adds it up over a document's links, and
    ``n_best`` counts the links whose pair's count is the highest of its A id. Texts that are null, empty or that the
    tokens of either don't add up to (as those with U+2581) have no tokens, zeros and an empty ``groups_sha256``. Rows
    with equal or null ids are documents by themselves; an empty table gives no rows.
    """
    # a row is a whole block, some 30 MB in memory
    blocks = materialise(blocks_of(docs, tokenizer_file, pattern, model_file), "aligned", rows_a_file=1)
    pairs = blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("n"))
    highest = F.max("n").over(W.partitionBy(F.shiftright("pair", ID_BITS)))  # as many rows as B has ids at most
    counts = counts.select("pair", "n", (F.col("n") == highest).alias("best"))
    back = pairs.select(F.col("block").alias("of"), "pair").join(counts, "pair")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(right.column("pair").to_numpy(), kind="stable")
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        for docs, at, times in zip(*(left.column(c) for c in ("docs", "at", "times")), strict=True):
            docs = pa.RecordBatch.from_struct_array(docs.values)
            at, times = np.cumsum(at.values.to_numpy(), dtype=np.int64), times.values.to_numpy().astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(docs.column("n_pairs").to_numpy())])
            upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
            out.append(
                pa.table(
                    [docs.column("doc_id"), *(docs.column(c) for c in names), pa.array(upto(times * best[at])), pa.array(upto(times * n[at])), docs.column("groups_sha256")],
                    ["doc_id", *names, "n_best", "count_sum", "groups_sha256"],
                )
            )
        return pa.concat_tables(out)

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in names), "n_best long", "count_sum long", "groups_sha256 string"])
    return blocks.select("block", "docs", "at", "times").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(total, schema)
