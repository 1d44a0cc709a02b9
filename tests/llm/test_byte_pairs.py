"""Byte-level BPE against the libraries of the vocabularies."""

import base64
import hashlib
import random
from functools import lru_cache

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketloom.llm.byte_pairs import BytePairs, Memo, encode_bytes, json_codec, last_merge, rank_codec
from marketloom.llm.queries import QUERIES
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@lru_cache
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def json_library():
    out = Tokenizer.from_file(JSON)
    out.encode_special_tokens = True
    return out


def same(text):
    ids = rank_codec(RANKS, PATTERN).encode(text).tolist()
    assert ids == library().encode_ordinary(text), ascii(text)
    assert rank_codec(RANKS, PATTERN).decode(ids) == text.encode()
    assert json_codec(JSON, PATTERN).encode(text).tolist() == json_library().encode(text, add_special_tokens=False).ids, ascii(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_white_space_and_characters_that_editions_of_unicode_know_or_not():
    rng = random.Random(3)
    some = [*"ab 's\n\t!1é", "\x85", "\xa0", "\x1c", " ", "　", "😀", "՘", "࢏", "꟒", "\U00011de0", "\U0001246f", "<|endoftext|>"]
    for _ in range(1500):
        same("".join(rng.choice(some) for _ in range(rng.randint(0, 12))))


def test_repeated_and_long_matches():
    for text in ("a" * 3000, "ab" * 2000, " " * 3000, "\n" * 999, "日本" * 500, "x" * 31 + "1" * 31):
        same(text)
    assert len(rank_codec(RANKS, PATTERN).encode("ab" * 200_000)) > 0


def merged(data, ranks):
    """Merging as described: again and again the leftmost pair of the least rank."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_trained_like_vocabularies_of_few_letters():
    """Many overlapping tokens: the search has to go back. Merges are made one after the other, as training does."""
    rng, went_back = random.Random(5), 0
    for _ in range(40):
        ranks = {bytes([b]): b for b in range(256)}
        corpus = bytes(rng.choice(b"abc") for _ in range(300))
        for _ in range(25):
            ids = merged(corpus, ranks)
            back = {v: k for k, v in ranks.items()}
            a, b = rng.choice([x for x in zip(ids, ids[1:])])
            ranks.setdefault(back[a] + back[b], len(ranks))
        pairs = BytePairs(ranks, whole=False)
        for _ in range(60):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40)))
            assert list(pairs.encode(data)) == merged(data, ranks)
            went_back += any(t is None for t in pairs.fitting.values())
    assert went_back


def test_tokens_that_merging_never_makes_are_for_whole_matches_only():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abx": 257}
    assert last_merge(b"abx", ranks) is None
    assert BytePairs(ranks).encode(b"abx") == [257]
    assert BytePairs(ranks, whole=False).encode(b"abx") == [97, 98, 120]
    assert list(BytePairs(ranks).encode(b"abxabx")) == merged(b"abxabx", ranks)


def test_a_vocabulary_without_all_bytes_is_an_error():
    with pytest.raises(ValueError):
        BytePairs({b"a": 0})


def test_a_memo_stays_small():
    memo = Memo(lambda k: k, 10)
    assert [memo[k] for k in range(100)] == list(range(100)) and len(memo) <= 10
    memo = Memo(len, 10)
    assert memo["x" * 1000] == 1000 and not memo


def test_odd_texts(spark):
    rows = encode_bytes(odd_docs(spark), RANKS, PATTERN, keep=("doc_id", "text", "slot")).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    for r in rows:
        assert r["ids"] == library().encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert encode_bytes(empty_docs(spark), RANKS, PATTERN).count() == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library().encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
