"""Alignment of two tokenizers against a plain count over bytes, and the matrices against dense ones."""

import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from marketloom.llm import alignment
from marketloom.llm.alignment import CSR, align_tokenizers, aligner, product, row_terms, transposed
from marketloom.llm.byte_pairs import byte_letters
from marketloom.llm.queries import QUERIES
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
ZERO = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0, "groups_sha256": ""}


@lru_cache
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[2])


def tokens(text):
    """Ids and bytes of both tokenizers by their libraries; None without tokens."""
    if not text:
        return None
    a, b = libraries()
    letters = byte_letters()
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = b" " + text.encode()
    return (left, right) if all(b"".join(t for _, t in side) == want for side in (left, right)) else None


def expected(texts):
    linked, out, holding = [], [], defaultdict(set)
    for d, text in enumerate(texts):
        found = tokens(text)
        links: Counter = Counter()
        if found is None:
            linked.append(links)
            out.append(dict(ZERO))
            continue
        owner = [[k for k, (_, t) in enumerate(side) for _ in t] for side in found]
        over = set(zip(*owner))
        ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in found]
        groups, at = [], 0
        for end in sorted(ends[0] & ends[1]):
            parts = [sorted({k for k in o[at:end]}) for o in owner]
            groups.append("|".join(",".join(str(side[k][0]) for k in ks) for side, ks in zip(found, parts)))
            at = end
        for x, y in over:
            pair = found[0][x][0], found[1][y][0]
            links[pair] += 1
            holding[pair].add(d)
        linked.append(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append({"n_a": len(found[0]), "n_b": len(found[1]), "n_groups": len(groups), "n_links": len(over), "groups_sha256": digest})
    best: dict = {}
    for (x, _), ds in holding.items():
        best[x] = max(best.get(x, 0), len(ds))
    for row, links in zip(out, linked):
        row["n_best"] = sum(n for p, n in links.items() if len(holding[p]) == best[p[0]])
        row["count_sum"] = sum(n * len(holding[p]) for p, n in links.items())
    return out


def plain(rows):
    return sorted(tuple(sorted((k, r[k]) for k in ZERO)) for r in rows)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    rows = sorted(QUERIES["op13_tokenizer_alignment"](spark, sf).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    for r, want in zip(rows, expected([d["text"] for d in docs])):
        assert {k: r[k] for k in want} == want


def test_odd_texts_and_repeated_rows_in_small_blocks(spark, monkeypatch):
    texts = [*ODD_TEXTS, ODD_TEXTS[8], None, "no id here at all"]
    want = plain(expected(texts))
    assert plain(align_tokenizers(odd_docs(spark), *FILES).collect()) == want
    assert sum(r[3][1] == 0 for r in want) < len(want)
    assert align_tokenizers(empty_docs(spark), *FILES).count() == 0


def test_a_block_for_each_text(spark, monkeypatch):
    texts = [f"word{i % 3} and more 日本 {i % 5}" for i in range(40)] + ["x ▁ y", "<s> </s> <0x41> <|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    monkeypatch.setattr("marketloom.llm.pieces.ROOM", 1)
    rows = sorted(align_tokenizers(docs, *FILES).collect(), key=lambda r: r["doc_id"])
    want = expected(texts)
    assert [{k: r[k] for k in ZERO} for r in rows] == want and want[-2] == ZERO and want[-1]["n_a"] > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=25), max_size=4))
def test_any_texts(texts):
    found = aligner(*FILES).align(texts)
    for k, want in enumerate(expected(texts)):
        assert [found.n_a[k], found.n_b[k], found.n_groups[k], found.n_links[k]] == [want[c] for c in ("n_a", "n_b", "n_groups", "n_links")]
        assert (hashlib.sha256(found.groups[k]).hexdigest() if found.groups[k] else "") == want["groups_sha256"]
        assert found.n_group_links[k] >= found.n_links[k]


def dense(m):
    out = np.zeros((len(m.starts) - 1, m.columns), int)
    for i in range(len(out)):
        for k in range(m.starts[i], m.starts[i + 1]):
            out[i, m.indices[k]] += m.values[k]
    return out


def sparse(a):
    rows = [np.flatnonzero(r) for r in a]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(int)
    indices = np.concatenate([np.empty(0, int), *rows]).astype(int)
    return CSR(starts, indices, a[np.repeat(np.arange(len(a)), np.diff(starts)), indices].astype(int), a.shape[1])


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 5), st.integers(1, 5), st.integers(0, 5), st.randoms(use_true_random=False))
def test_products_of_rows(n, k, m, rng):
    a = np.array([[rng.choice([0, 0, 1, 2]) for _ in range(k)] for _ in range(n)], int).reshape(n, k)
    b = np.array([[rng.choice([0, 1, 3]) for _ in range(m)] for _ in range(k)], int).reshape(k, m)
    assert (dense(product(sparse(a), sparse(b))) == a @ b).all()
    assert (dense(transposed(sparse(a))) == a.T).all()
    if n and (a != 0).any(axis=1).all():
        assert row_terms(sparse(a), sparse(b)).tolist() == ((a != 0).astype(int) @ (b != 0).astype(int)).sum(axis=1).tolist()


def test_the_byte_letters_are_those_of_the_library():
    for letter, byte in byte_letters().items():
        if byte < 128:
            assert ByteLevel().decode([letter]) == chr(byte)


def test_no_file_holds_many_blocks_and_no_block_many_empty_texts(spark, monkeypatch):
    seen, materialise = [], alignment.materialise
    monkeypatch.setattr(alignment, "materialise", lambda *a, **k: seen.append(materialise(*a, **k)) or seen[-1])
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 4096)
    docs = spark.createDataFrame(list(enumerate(["some words to align"] * 40 + [None] * 60)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert align_tokenizers(docs, *FILES).count() == 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [r.n for r in seen[0].groupBy("_metadata.file_path").agg(F.count("*").alias("n")).collect()]
    assert len(files) > 2 and max(files) == 1
    assert max(r.n for r in seen[0].select(F.size("docs").alias("n")).collect()) <= 32
