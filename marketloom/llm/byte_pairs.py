"""Byte-level BPE: the exact result of merging, in time linear in the text, and decoding.

A text is cut by the vocabulary's pattern, and each match is encoded by itself:

1. Its bytes, mapped to Latin-1, run through an Aho-Corasick automaton of all tokens (pyahocorasick), which gives the
   longest token at every byte.
2. A sequence of tokens is what merging gives exactly if each two neighbours are compatible: merging the bytes of both
   gives these two again. So the search takes the longest token at each place, falls back to the token's next shorter
   prefix where it is not compatible with the one before, and goes a token back where no prefix is left. Places from
   which nothing leads on are marked, so that each is left but once.
3. Compatibility follows from how the two tokens came about: a merge across their border takes place if it ranks before
   the merges that use up both of its sides. It is worked out once for a pair and kept.

Tokens that merging never makes stand outside the automaton; a match that is such a token as a whole is still encoded
by it where the library looks whole matches up first (``whole``).
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.pieces import groups

#: Bounds of what a task keeps: encoded chunks, encoded matches, pairs of tokens; and the longest key that is kept.
MOST_CHUNKS, MOST_MATCHES, MOST_PAIRS, MOST_KEY = 1 << 19, 1 << 17, 1 << 20, 64
NEVER = 1 << 60


class Memo(dict):
    """Values of a function; emptied when it holds ``most``. Keys of more than ``MOST_KEY`` characters are not kept."""

    def __init__(self, of: Callable, most: int):
        self.of, self.most = of, most

    def __missing__(self, key):
        value = self.of(key)
        if isinstance(key, int) or len(key) <= MOST_KEY:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging joins at last to give ``token``; None if it does not give it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NEVER:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class BytePairs:
    """Encoding of single matches, and decoding, by the ranks of tokens, which are their ids."""

    def __init__(self, ranks: dict[bytes, int], whole: bool = True):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.tokens: list[bytes | None] = [None] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = [len(t or b"") for t in self.tokens]
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole = ranks if whole else {}
        self.automaton = ahocorasick.Automaton()
        made: dict[bytes, int] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                found = last_merge(token, ranks)
                if found is None:
                    continue
                self.parts[rank] = ranks[found[0]], ranks[found[1]]
                if max(self.parts[rank]) > rank and min(map(len, found)) > 1:
                    raise ValueError(f"{token!r} ranks before its parts")
            made[token] = rank
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.joins = {a << 32 | b: rank for rank, (a, b) in self.parts.items()}
        #: The longest other token that each token begins with.
        self.shorter: list[int | None] = [None] * len(self.tokens)
        for token, rank in made.items():
            self.shorter[rank] = next((made[p] for n in range(len(token) - 1, 0, -1) if (p := token[:n]) in made), None)
        self.fitting = Memo(self._fitting, MOST_PAIRS)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that have stood at a side of ``token``, and the rank of the merge that used each of them up."""
        out, until = [(token, NEVER)], token
        while token in self.parts:
            token, until = self.parts[token][side], token
            out.append((token, until))
        return out

    def _compatible(self, left: int, right: int) -> bool:
        for x, x_until in self._edge(left, 1):
            for y, y_until in self._edge(right, 0):
                # of equal merges the one further left is the first
                if (rank := self.joins.get(x << 32 | y)) is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def _fitting(self, pair: int) -> int | None:
        """The longest prefix of the pair's second token, or that token, that is compatible with its first."""
        before, token = pair >> 32, pair & 0xFFFFFFFF
        while token is not None and not self._compatible(before, token):
            token = self.shorter[token]
        return token

    def encode(self, data: bytes) -> list[int]:
        """The tokens that merging makes of one match."""
        if not data:
            return []
        if (known := self.whole.get(data)) is not None:
            return [known]
        size, shorter, fitting, n = self.size, self.shorter, self.fitting, len(data)
        longest: list[int | None] = [None] * (n + 1)
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # of those that start here the longest ends last
        dead = bytearray(n + 1)
        out = [longest[0]]
        at = size[out[0]]
        token = longest[at]
        while at < n:
            while token is not None and (token := fitting[out[-1] << 32 | token]) is not None and dead[at + size[token]]:
                token = shorter[token]
            if token is None:
                # nothing leads on from here: the token before gives way to a shorter one
                while token is None:
                    dead[at] = 1
                    last = out.pop()
                    at, token = at - size[last], shorter[last]
                if not out:
                    out.append(token)
                    at = size[token]
                    token = longest[at]
            else:
                out.append(token)
                at += size[token]
                token = longest[at]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: Characters that stand for a letter, a number and anything else.
STAND_INS = {"x": "é", "1": "1", "!": "!"}


class Splitter:
    """Cuts a text by the vocabulary's pattern as the library does.

    Which characters are letters or numbers depends on the edition of Unicode, and libraries differ in it. Characters
    that an edition may not know yet are put to the library itself (``joined``: those of some characters that form one
    match with another one before them), and the pattern then sees one of the same kind in their place.
    """

    def __init__(self, pattern: str, joined: Callable[[str, list[str]], set[str]]):
        self.find, self.joined = regex.compile(pattern).findall, joined
        self.known: set[str] = set()
        self.odd: dict[int, str] = {}

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and (new := set(text) - self.known):
            unsure = [c for c in new if unicodedata.category(c) == "Cn"]
            if unsure:
                for lead, stand_in in reversed(STAND_INS.items()):
                    self.odd |= {ord(c): stand_in for c in self.joined(lead, unsure)}
            self.known |= new
        if self.odd and not text.isascii() and (shown := text.translate(self.odd)) != text:
            ends = np.cumsum([0, *map(len, self.find(shown))]).tolist()
            return [text[a:b] for a, b in zip(ends, ends[1:])]
        return self.find(text)


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, pairs: BytePairs, splitter: Splitter):
        self.pairs, self.split = pairs, splitter
        # encoded ids lie there as bytes, which take little room and are joined at once
        self.match = Memo(lambda m: array("i", pairs.encode(m.encode())).tobytes(), MOST_MATCHES)
        self.head = Memo(self._chunk, MOST_MATCHES)
        self.spaced = Memo(lambda c: self._chunk(" " + c), MOST_CHUNKS)
        # a space that a character follows always begins a match; after it this is not so in runs of white space
        self.run, self.cut = re.compile(r" (?=\s|\Z)"), re.compile(r" (?=\S)")

    def _chunk(self, chunk: str) -> bytes:
        if len(matches := self.split(chunk)) == 1:
            return array("i", self.pairs.encode(chunk.encode())).tobytes()
        return b"".join(map(self.match.__getitem__, matches))

    def encode(self, text: str) -> np.ndarray:
        head, *rest = self.cut.split(text) if self.run.search(text) else text.split(" ")
        return np.frombuffer(self.head[head] + b"".join(map(self.spaced.__getitem__, rest)), np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.pairs.decode(ids)


@lru_cache(maxsize=2)
def rank_codec(rank_file: str, pattern: str) -> Codec:
    """A codec by a file of ranks, which gives what ``encode_ordinary`` of tiktoken gives."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}

    def joined(lead: str, chars: list[str]) -> set[str]:
        own = {bytes([b]): b for b in range(256)} | {(lead + c).encode(): 256 + i for i, c in enumerate(chars)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        return {c for c in chars if len(probe.encode_ordinary(lead + c)) == 1}

    return Codec(BytePairs(ranks), Splitter(pattern, joined))


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as it is, others from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def json_codec(tokenizer_file: str, pattern: str) -> Codec:
    """A codec by a tokenizer's JSON file, which gives what the tokenizers library gives without special tokens."""
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not held["normalizer"]
    if model["type"] != "BPE" or not plain or model["dropout"] or model["ignore_merges"]:
        raise ValueError(f"{tokenizer_file} is no plain byte-level BPE")
    byte = byte_letters()
    written = lambda t: bytes(map(byte.__getitem__, t))
    special = {t["content"] for t in held["added_tokens"]}
    ranks = {written(t): i for t, i in model["vocab"].items() if t not in special}
    pairs = BytePairs(ranks, whole=False)
    listed = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [(ranks[written(a + b)], (ranks[written(a)], ranks[written(b)])) for a, b in listed]
    if order != sorted(order) or dict(order) != pairs.parts:
        raise ValueError(f"the merges of {tokenizer_file} are not in the order of its ids")
    shown = Tokenizer.from_file(tokenizer_file).pre_tokenizer.pre_tokenize_str
    return Codec(pairs, Splitter(pattern, lambda lead, chars: {c for c in chars if len(shown(lead + c)) == 1}))


def encode_bytes(docs: DataFrame, rank_file: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (``text``) with ``ids`` (array) and ``decoded`` (binary).

    Null text counts as empty; an empty text has no ids and decodes to no bytes. Whole texts of any length are encoded,
    in time linear in their length; strings of special tokens are ordinary text. Rows with equal or null ids are
    encoded each by itself; other columns are ignored; an empty table gives no rows. ``rank_file`` is read by every
    executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(rank_file, pattern)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for at, end in groups(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
                ids = [codec.encode(t or "") for t in text.slice(at, end - at).to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                decoded = pa.array([codec.decode(i.tolist()) for i in ids], pa.binary())
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k) for k in range(part.num_columns - 1)),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32())),
                        decoded,
                    ],
                    [*keep, "ids", "decoded"],
                )

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, ids array<int>, decoded binary")
