import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from marketloom.llm.mixing import mix_sources
from marketloom.llm.secrets import scan_secrets
from tests.llm.helpers import empty_docs, odd_docs
from tests.llm.test_jaccard import brute

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_every_stage_takes_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(P.COLUMNS)
    seen = {}
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "pieces":
            assert docs.columns == P.COLUMNS
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in seen["quality"].collect()}
    clean = {i for i, r in labels.items() if r.quality == 1}
    assert len(clean & kept.keys()) >= 0.9 * len(clean) and len(kept) < spark.read.parquet(f"{sf}/documents.parquet").count()
    groups = {g for _, _, g, _ in brute(kept)}
    alone = {r.doc_id: r.text for r in seen["near_copies"].collect()}
    assert alone.keys() == groups
    masked = {r.doc_id: r for r in seen["secrets"].collect()}
    found = {r.doc_id: len(r.found) for r in scan_secrets(seen["near_copies"]).collect()}
    assert masked.keys() == alone.keys()
    for i, r in masked.items():
        assert (r.text != alone[i]) == bool(found[i]) and r.n_chars == len(r.text)
    assert all(not r.found for r in scan_secrets(seen["secrets"]).collect())
    assert {tuple(r) for r in seen["mixing"].collect()} == {tuple(r) for r in masked.values()}
    last = {r.doc_id: r for r in seen["pieces"].collect()}
    assert last.keys() == masked.keys()
    for i, r in last.items():
        assert r.ids == LIBRARY.encode(masked[i].text) and r.n_tokens == len(r.ids)


def test_odd_rows(spark, sf):
    for make in (odd_docs, empty_docs):
        docs = make(spark).select(P.COLUMNS)
        for _, stage in P.STAGES[1:]:
            assert stage(spark, docs, sf).count() <= docs.count()
        assert P.quality(spark, docs, sf).columns == P.COLUMNS
    twice = odd_docs(spark).filter("doc_id = 8").select(P.COLUMNS)
    assert P.near_copies(spark, twice.unionByName(twice), sf).count() == 1


def test_texts_of_one_id_are_kept_apart(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, None, "s", 1), (1, a, "de", "s", 1), (2, b, "en", "s", 1), (2, c, "en", "s", 1), (None, a, "en", "s", 1), (None, a, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        got = sorted(((r.doc_id, r.text, r.lang) for r in P.near_copies(spark, docs.repartition(parts), sf).collect()), key=str)
        assert got == sorted([(1, a, None), (1, b, "en"), (2, c, "en"), (None, a, "en"), (None, a, "en")], key=str)


def test_the_last_stage_shows_the_mix_of_several_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(P.COLUMNS)
    written = {r.doc_id: (r.slot, r.in_block) for r in mix_sources(docs, P.PARTS).collect()}
    P.mixing(spark, docs, sf).repartition(3).write.parquet(str(tmp_path / "mixing"))
    rows = P.pieces(spark, spark.read.parquet(str(tmp_path / "mixing")), sf).collect()
    assert {r.doc_id: (r.slot, r.in_block) for r in rows} == written and len({(r.slot, r.in_block) for r in rows}) == len(rows)
    alike = P.PARTS
    P.PARTS = dict.fromkeys(alike, 1)
    try:
        other = {r.doc_id: (r.slot, r.in_block) for r in P.pieces(spark, docs, sf).collect()}
    finally:
        P.PARTS = alike
    assert other != written


def test_the_last_stage_takes_its_places_from_the_mix(spark, sf, monkeypatch):
    docs = odd_docs(spark).select(P.COLUMNS)
    monkeypatch.setattr(P, "table", lambda *_: docs)
    monkeypatch.setattr(P, "STAGES", P.STAGES[3:])
    wanted = {(r.doc_id, r.slot, r.in_block) for r in mix_sources(docs, P.PARTS).collect()}
    # places that only the mix can have given
    monkeypatch.setitem(P.HANDED, "mixing", lambda *args: P.placed(*args).withColumn("slot", -1 - F.col("slot")))
    got = {(r.doc_id, -1 - r.slot, r.in_block) for r in P.run(spark, sf).collect()}
    assert got == wanted
