"""SentencePiece encoding and decoding with the byte spans of every piece.

Ids come from the sentencepiece library. The spans come from a normaliser of our own, which applies the model's
compiled character map by longest prefixes and records, for each byte of the normalised text, the original byte that
it stems from; the pieces are laid along the normalised text, and every one is projected back to the original bytes.

The compiled map is a little-endian 32-bit length, a double-array trie of 32-bit units of that length, and
replacement strings that end in zero bytes. With an empty map, and spaces kept as they are, only spaces change: whole
batches are then normalised and aligned at once, as arrays.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Bytes of text that are encoded together.
ROOM = 262_144


class CharMap:
    """Longest-prefix replacement by a compiled character map; an empty map changes nothing."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that is a prefix of ``data[at:]``."""
        if not self.units:
            return None
        units, best, node = self.units, None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]


class Normaliser:
    """The model's normalisation, with the source of each byte."""

    def __init__(self, spec, kept: list[bytes] = ()):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.kept = re.compile(b"|".join(re.escape(k) for k in sorted(kept, key=len, reverse=True))) if kept else None

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.kept and (m := self.kept.match(data, at)):
            return m.end() - at, m[0]
        if found := self.map.longest(data, at):
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised bytes and, for each of them and for the end, the original byte offset."""
        data, at = text.encode(), 0
        space = SPACE_BYTES if self.escape else b" "
        out, source = bytearray(), []
        while self.squeeze and at < len(data):
            n, piece = self._step(data, at)
            if piece != b" ":
                break
            at += n
        if at == len(data):
            return b"", [at]
        if self.prefix:
            out += space
            source += [at] * len(space)
        spaced = self.squeeze
        while at < len(data):
            n, piece = self._step(data, at)
            if spaced:
                piece = piece.lstrip(b" ")
            if piece:
                shown = piece.replace(b" ", space) if self.escape else piece
                out += shown
                source += range(at, at + n) if shown == data[at : at + n] else [at] * len(shown)
                spaced = self.squeeze and piece.endswith(b" ")
            at += n
        source.append(at)
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            source = source[: len(out)] + [source[len(out)]]
        return bytes(out), source


    def aligned(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The original byte offset of every normalised byte and end, text after text, and how many there are of each."""
        if self.map.units or self.kept or self.squeeze or not (self.prefix and self.escape):
            sources = [np.asarray(self(t)[1] if t else [0], np.int64) for t in texts]
            return np.concatenate([np.empty(0, np.int64), *sources]), np.array([len(x) for x in sources], np.int64)
        # a space before each text, and one byte for its end
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(x for t in raw for x in ((b" " if t else b""), t, b"\0")), np.uint8)
        size = np.array([len(t) for t in raw], np.int64)
        laid = size + 1 + (size > 0)
        first = np.cumsum(laid) - laid
        offset = np.arange(len(data)) - np.repeat(first + (size > 0), laid)
        width = np.where(data == 32, len(SPACE_BYTES), 1)
        return np.repeat(np.maximum(offset, 0), width), np.add.reduceat(width, first) if len(first) else size


class Codec:
    """Encoding with spans, and decoding, by one model."""

    def __init__(self, model_file: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto.FromString(open(model_file, "rb").read())
        self.normalise = Normaliser(model.normalizer_spec, [p.piece.encode() for p in model.pieces if p.type == p.USER_DEFINED])
        #: Bytes of each piece in the normalised text; those of unknown pieces differ from place to place.
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN}

    def _laid(self, text: str, ids: list[int]) -> np.ndarray:
        """Sizes of a text's pieces in the normalised text."""
        if self.unknown.isdisjoint(ids):
            return self.sizes[ids]
        shown = self.sp.encode(text, out_type=str)
        return np.array([len(s.encode()) if i in self.unknown else self.sizes[i] for i, s in zip(ids, shown, strict=True)], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids of each text as the library gives them, and for all pieces, text after text, start and end in its bytes.

        Spans of neighbouring pieces share a bound; the prefix space that the model adds has no bytes of its own.
        """
        ids = self.sp.encode(texts, num_threads=1)
        source, laid = self.normalise.aligned(texts)
        count = np.array([len(i) for i in ids], np.int64)
        sizes = np.concatenate([self._laid(t, i) for t, i in zip(texts, ids) if i] or [np.empty(0, np.int64)])
        text = np.repeat(np.arange(len(texts)), count)
        ends = np.cumsum(sizes) + text  # every text before has one entry more, for its end
        if (np.bincount(text, sizes, len(texts)) != laid - 1).any():
            raise ValueError("the pieces don't add up to the normalised text")
        return ids, source[ends - sizes], source[ends]


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of groups of texts of about ``ROOM`` bytes; a longer text is one by itself."""
    at, size = 0, 0
    for k, n in enumerate(sizes):
        if k > at and size + n > ROOM:
            yield at, k
            at, size = k, 0
        size += n
    if sizes:
        yield at, len(sizes)


def encode_decode(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (``text``) with ``ids``, ``starts``, ``ends`` (arrays) and ``decoded``.

    Null text counts as empty; an empty text has no ids and decodes to an empty one. Whole texts of any length are
    encoded. Rows with equal or null ids are encoded each by itself; other columns are ignored; an empty table gives
    no rows. ``model_file`` is read by every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            # only one group's texts are Python strings at a time
            for at, end in groups(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
                ids, starts, ends = c.encode([t or "" for t in text.slice(at, end - at).to_pylist()])
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = np.fromiter(chain.from_iterable(ids), np.int32, len(starts))
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (flat, starts, ends)]
                decoded = pa.array(c.sp.decode(ids, num_threads=1), pa.string())
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(part.num_columns - 1)), *arrays, decoded],
                    [*keep, "ids", "starts", "ends", "decoded"],
                )

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, ids array<int>, starts array<int>, ends array<int>, decoded string")
