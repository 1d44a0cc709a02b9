import struct
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from marketloom.llm.pieces import CharMap, Normaliser, encode_decode
from marketloom.llm.pieces import codec as shared
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\tabzcé▁.=0\x00"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_equals_the_library_and_spans_tile_the_texts(texts):
    c = shared(MODEL)
    ids, starts, ends = c.encode(texts)
    assert ids == [c.sp.encode(t) for t in texts]
    at = 0
    for text, i in zip(texts, ids):
        s, e = list(starts[at : at + len(i)]), list(ends[at : at + len(i)])
        at += len(i)
        assert s[:1] == [0][: len(i)] and e[-1:] == [len(text.encode())][: len(i)] and s[1:] == e[:-1]
    # the arrays of a whole batch are what the normaliser gives text by text
    source, laid = c.normalise.aligned(texts)
    assert list(source) == [x for t in texts for x in (c.normalise(t)[1] if t else [0])] and laid.sum() == len(source)


@pytest.mark.parametrize("squeeze", [False, True])
def test_a_model_with_a_character_map(tmp_path, squeeze):
    model = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    table = {b"a": b"1", b"ab": b"22", "é".encode(): b"e", b"\t": b" ", b"zz": b"", "日本".encode(): b"c c"}
    model.normalizer_spec.precompiled_charsmap = compiled(table)
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    c = shared(str(path))

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet="abzé\t 日本x▁", max_size=30), max_size=4))
    def check(texts):
        ids, starts, ends = c.encode(texts)
        assert ids == [c.sp.encode(t) for t in texts]
        at = 0
        for text, i in zip(texts, ids):
            for p in c.sp.encode(text, return_type="proto").pieces if i else ():
                if not c.sp.is_byte(p.id):  # the library gives a character's bytes together
                    assert (starts[at], ends[at]) == (p.begin, p.end), (text, p)
                at += 1
        assert at == len(starts)

    check()


def test_long_text_in_bounded_time(library):
    text = "many words of a long text, again and again " * 200_000
    began = time.monotonic()
    ids, _, ends = shared(MODEL).encode([text])
    assert ends[-1] == len(text) and time.monotonic() - began < 60


def test_every_document(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode_decode(docs, MODEL).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.ids == ids and r.decoded == library.decode(ids)
        raw = texts[r.doc_id].encode()
        spans = [raw[s:e] for s, e in zip(r.starts, r.ends)]
        assert b"".join(spans) == raw
        for i, span in list(zip(ids, spans))[1:]:
            if not library.is_byte(i):
                assert library.id_to_piece(i).replace("▁", " ").encode() == span


def test_odd_rows(spark, library):
    rows = encode_decode(odd_docs(spark), MODEL).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == library.encode(ODD_TEXTS[r.doc_id] or "")
    assert encode_decode(empty_docs(spark), MODEL).count() == 0


def compiled(table):
    """A character map as its compiled form: a double array with one unit a node, by first fit."""
    trie = {}
    for key, value in table.items():
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[None] = value
    strings, at = b"", {}
    for value in table.values():
        at[value] = len(strings)
        strings += value + b"\0"
    units, used = [0] * 4096, {0}

    def place(node, here):
        labels = [0 if b is None else b for b in node]
        base = next(x for x in range(1, 2048) if all((x ^ b) not in used and (x ^ here) < 2**21 for b in labels))
        units[here] |= (base ^ here) << 10 | (0x100 if None in node else 0)
        used.update(base ^ b for b in labels)
        for b, child in node.items():
            if b is None:
                units[base] = 1 << 31 | at[child]
            else:
                units[base ^ b] |= b
        for b, child in node.items():
            if b is not None:
                place(child, base ^ b)

    place(trie, 0)
    blob = struct.pack("<4096I", *units)
    return struct.pack("<I", len(blob)) + blob + strings


class Spec:
    add_dummy_prefix = remove_extra_whitespaces = escape_whitespaces = True
    precompiled_charsmap = b""


def test_longest_prefix_and_alignment():
    table = {b"a": b"1", b"ab": b"22", "é".encode(): b"e", b"\t": b" ", b"zz": b""}
    blob = compiled(table)
    m = CharMap(blob)
    assert m.longest(b"abc", 0) == (2, b"22") and m.longest(b"ac", 0) == (1, b"1") and m.longest(b"c", 0) is None
    spec = Spec()
    spec.precompiled_charsmap = blob
    norm, source = Normaliser(spec)("\t ab\t cézz ")
    assert norm.decode() == "▁22▁ce"
    assert source == [2, 2, 2, 2, 2, 4, 4, 4, 6, 7, 11]


def test_squeezed_and_empty():
    assert Normaliser(Spec())("   ") == (b"", [3])
    norm, source = Normaliser(Spec())("  a  b  ")
    assert norm.decode() == "▁a▁b" and source[0] == 2 and len(source) == len(norm) + 1
