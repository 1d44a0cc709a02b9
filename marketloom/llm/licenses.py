"""License scans: short notices found with a bounded number of errors.

A notice is told from its siblings by its key, some words in a row (``mit``, ``gnu general public``), so these stand in
a match unchanged; at most ``k`` characters of the rest may be inserted, deleted or replaced. The rest is cut into
``k + 1`` pieces, of which one at least is then unchanged (the pigeonhole principle): key and pieces are the seeds that
are searched exactly. As an edit spoils at most three of the rest's runs of three characters, all but ``3 k`` of these
must be near a key as well; where they are, the regex library's bounded-error matching decides on both sides of the key
and gives spans and edits. Every place of a key is judged by itself, so that no find hides another one.

Texts are compared as their lower-cased words, joined by single spaces: line breaks and punctuation cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of the method, in words as above: label, key, and words that make it another license if they follow the key.
NOTICES = {
    "released under the mit license": ("mit", "mit", ""),
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit", "copy of this software", ""),
    "licensed under the apache license version 2 0": ("apache", "apache", ""),
    "licensed under the gnu general public license version": ("gpl", "gnu general public", ""),
    "licensed under the gnu lesser general public license": ("lgpl", "gnu lesser general public", ""),
    "licensed under cc by nc 4 0": ("cc-by-nc", "cc by nc", "sa nd"),
    "licensed under a creative commons attribution": ("cc-by", "creative commons attribution", "noncommercial non sharealike share noderivatives noderivs no nc sa nd"),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", "source and binary forms", ""),
    "subject to the terms of the mozilla public license": ("mpl", "mozilla", ""),
}
#: One error for so many characters of a notice.
CHARACTERS_AN_ERROR = 10
#: Bytes of lower-cased text between words.
_BETWEEN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

MATCH = "label string, notice string, edits int, first_word long, last_word long, start long, end long"


class Notice:
    """One notice: what stands before and after its key, the seeds of both, and their patterns."""

    def __init__(self, text: str, label: str, key: str, siblings: str, errors: int):
        self.text, self.label, self.errors = text, label, errors
        at = f" {text} ".index(f" {key} ")
        self.before, self.key, self.after = text[:at], key.encode(), text[at + len(key) :]
        self.siblings = {w.encode() for w in siblings.split()}
        self.pieces = [p.encode() for p in self._pieces()]
        sides = [s.encode() for s in (self.before, self.after)]
        self.runs = [s[i : i + 3] for s in sides for i in range(len(s) - 2)]
        fuzzy = lambda part: f"(?:{regex.escape(part)}){{e<={errors}}}"
        self.left = regex.compile(fuzzy(self.before) + r"\Z", regex.BESTMATCH) if self.before else None
        self.right = regex.compile(fuzzy(self.after), regex.BESTMATCH) if self.after else None

    def _pieces(self) -> list[str]:
        """``errors + 1`` pieces of the two sides, none of them across the key."""
        size, many = len(self.before) + len(self.after), self.errors + 1
        left = min(len(self.before), max(many - len(self.after), round(many * len(self.before) / size))) if size else 0
        cut = lambda part, n: [part[len(part) * k // n : len(part) * (k + 1) // n] for k in range(n)]
        return cut(self.before, left) + cut(self.after, many - left)

    def matches(self, plain: bytes) -> Iterator[tuple[int, int, int]]:
        """Start and end in bytes, and edits."""
        seed = b" " + self.key + b" "
        reach = 4 * self.errors  # an inserted character may have four bytes
        at = plain.find(seed)
        while at >= 0:
            first, last = at + 1, at + 1 + len(self.key)
            low = max(0, first - len(self.before) - reach)
            high = last + len(self.after) + reach
            if self._candidate(plain, low, first, last, high) and plain[last + 1 : last + 16].split(b" ")[0] not in self.siblings:
                left, right = plain[low:first].decode("utf-8", "ignore"), plain[last:high].decode("utf-8", "ignore")
                a = self.left.search(left) if self.left else None
                b = self.right.match(right) if self.right else None
                edits = sum(sum(m.fuzzy_counts) for m in (a, b) if m)
                if (a or not self.left) and (b or not self.right) and edits <= self.errors:
                    yield first - len(a[0].encode() if a else b""), last + len(b[0].encode() if b else b""), edits
            at = plain.find(seed, at + 1)

    def _candidate(self, plain: bytes, low: int, first: int, last: int, high: int) -> bool:
        near = plain[low:first] + b"\0" + plain[last:high]
        if not any(p in near for p in self.pieces):
            return False
        return sum(run in near for run in self.runs) >= len(self.runs) - 3 * self.errors


@lru_cache(maxsize=4)
def _compiled(notices: tuple[tuple[str, tuple[str, str, str]], ...], characters: int) -> list[Notice]:
    return [Notice(text, *spec, len(text) // characters) for text, spec in notices]


def find_licenses(text: str | None, phrases: Mapping[str, str], notices: list[Notice]) -> tuple[int, list[tuple]]:
    """Number of words, and the matches as tuples in the order of ``MATCH``; exact phrases have null notices."""
    if not text:
        return 0, []
    words = text.encode().lower().translate(_BETWEEN).split()
    plain = b" " + b" ".join(words) + b" "
    found = []  # label, notice, edits, start and end in plain
    for phrase, label in phrases.items():
        key = f" {phrase} ".encode()
        at = plain.find(key)
        while at >= 0:
            found.append((label, None, 0, at + 1, at + len(key) - 1))
            at = plain.find(key, at + 1)
    for n in notices:
        found += [(n.label, n.text, edits, a, b) for a, b, edits in n.matches(plain)]
    if not found:
        return len(words), []
    places = [m.span() for m in _WORD.finditer(text)]
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    out = []
    for label, notice, edits, a, b in found:
        while plain[a : a + 1] == b" ":
            a += 1
        while plain[b - 1 : b] == b" ":
            b -= 1
        first, last = (int(np.searchsorted(spaces, x)) - 1 for x in (a, b))
        out.append((label, notice, edits, first, last, places[first][0], places[last][1]))
    return len(words), sorted(out, key=lambda x: (x[3], x[4], x[1] or ""))


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, tuple[str, str, str]] = NOTICES,
    characters_an_error: int = CHARACTERS_AN_ERROR,
) -> DataFrame:
    """``doc_id, n_words, matches`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``matches`` is an array of label, notice (null: an exact phrase), edits, first and last word (from 0) and start
    and end in code points of the text (end exclusive). Null text counts as empty: no words, no matches. Whole texts
    are searched; rows with equal or null ids each by itself; an empty table gives no rows. Every place of a notice's
    key is judged by itself, so matches may overlap; a notice whose key is misspelt is not found.
    """
    phrases, listed = dict(phrases), tuple(notices.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(listed, characters_an_error)
        names = [x.split()[0] for x in MATCH.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        kind = pa.list_(pa.struct(list(zip(names, kinds))))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [find_licenses(t, phrases, compiled) for t in part.column(1).to_pylist()]
                rows = [[dict(zip(names, m)) for m in matches] for _, matches in found]
                counts = pa.array([n for n, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(rows, kind)], ["doc_id", "n_words", "matches"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fields = ", ".join(x.replace(" ", ": ") for x in MATCH.split(", "))
    return source.mapInArrow(run, f"doc_id long, n_words long, matches array<struct<{fields}>>")
