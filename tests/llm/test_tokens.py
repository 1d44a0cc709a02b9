import public_tokenizers
import pytest

from marketloom.llm.queries import op9_token_counts
from marketloom.llm.tokens import EVENT, Ledger, byte_bpe, count_tokens
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs

BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path))


def test_signed_batches(spark, ledger):
    events = lambda *e: spark.createDataFrame(list(e), EVENT)
    assert ledger.totals().count() == 0
    assert ledger.commit("1", events((1, "insert", "a", "en", "t", 10), (2, "insert", "a", "en", "t", 5), (3, "revise", "b", None, "t", 7)))
    assert rows(ledger.totals()) == {("a", "en", "t", 2, 15), ("b", None, "t", 1, 7)}
    again = events((1, "insert", "a", "en", "t", 99))
    assert not ledger.commit("1", again) and rows(ledger.totals()) == {("a", "en", "t", 2, 15), ("b", None, "t", 1, 7)}
    ledger.commit("2", events((1, "revise", "b", None, "t", 12), (2, "delete", None, None, "t", None), (9, "delete", None, None, "t", None)))
    assert rows(ledger.totals()) == {("b", None, "t", 2, 19)}
    ledger.commit("3", events((1, "insert", "b", None, "t", 1), (1, "revise", "c", "en", "t", 4), (None, "insert", "c", "en", "t", 3), (5, "odd", "z", "z", "t", 3)))
    assert rows(ledger.totals()) == {("b", None, "t", 1, 7), ("c", "en", "t", 2, 7)}
    ledger.commit("4", events((1, "insert", "c", "en", "u", None), (1, "insert", "c", "en", "u", None)))
    assert ("c", "en", "u", 1, 0) in rows(ledger.totals())
    assert ledger.commit("5", events().limit(0)) and ledger.committed().count() == 5


def test_an_unfinished_batch_is_not_seen(spark, ledger, monkeypatch):
    events = spark.createDataFrame([(1, "insert", "a", "en", "t", 10)], EVENT)
    ledger.commit("1", events)
    monkeypatch.setattr(Ledger, "_claim", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    second = events.selectExpr("2L as doc_id", "op", "source", "lang", "tokenizer", "n_tokens")
    with pytest.raises(RuntimeError):
        ledger.commit("2", second)
    monkeypatch.undo()
    assert rows(ledger.totals()) == {("a", "en", "t", 1, 10)} and ledger.state().count() == 1
    assert ledger.commit("2", second)
    assert rows(ledger.totals()) == {("a", "en", "t", 2, 20)}


def test_two_writers_lose_nothing(spark, ledger, monkeypatch):
    event = lambda i, op, n: spark.createDataFrame([(i, op, "a", "en", "t", n)], EVENT)
    ledger.commit("0", event(1, "insert", 10))
    other, claim, raced = Ledger(spark, ledger.root), Ledger._claim, []

    def late(self, number, entry):
        if not raced:  # another writer commits between this one's reading and its claim
            raced.append(1)
            assert other.commit("theirs", event(1, "revise", 7))
        return claim(self, number, entry)

    monkeypatch.setattr(Ledger, "_claim", late)
    assert ledger.commit("mine", event(1, "revise", 3))
    assert rows(ledger.totals()) == {("a", "en", "t", 1, 3)} == rows(other.totals()) and ledger.committed().count() == 3
    raced.clear()
    monkeypatch.setattr(Ledger, "_claim", lambda self, n, e: (raced or (raced.append(1), other.commit("same", event(2, "insert", 1)))) and claim(self, n, e))
    assert not ledger.commit("same", event(2, "insert", 1)) and rows(ledger.totals()) == {("a", "en", "t", 2, 4)}


def test_compaction_odd_names_and_rejected_events(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), compact_every=2)
    event = lambda i, op, n: spark.createDataFrame([(i, op, "a", "en", "t", n)], EVENT)
    names = ["a/b=../c", "x y", "é?*", "'\"", ""]
    for k, name in enumerate(names):
        assert ledger.commit(name, event(k % 2, "revise", k + 1).unionByName(event(9, None if k else "odd", 5)))
        assert not ledger.commit(name, event(5, "insert", 1))
    assert rows(ledger.totals()) == {("a", "en", "t", 2, 9)} and {r.n_tokens for r in ledger.state().collect()} == {4, 5}
    assert sum(e["kind"] == "compact" for e in ledger._log()) == 2 and len(ledger._parts(ledger._log())[1]) == 1
    assert {r.batch for r in ledger.committed().collect()} == set(names)
    assert sorted(str(r.op) for r in ledger.rejected().collect()) == ["None"] * 4 + ["odd"]


def test_the_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    bad = {r.doc_id for r in labels if r.quality == 0}
    want = {}
    for i, r in docs.items():
        if i not in toxic:
            text = "\n".join(dict.fromkeys(r.text.split("\n"))) if i in bad else r.text
            for name, n in (("words-1", len(text.encode().split())), ("byte_bpe_50k-1", len(byte_bpe(*BPE).encode_ordinary(text)))):
                at = want.setdefault((r.source, r.lang, name), [0, 0])
                at[0] += 1
                at[1] += n
    assert rows(op9_token_counts(spark, sf)) == {(*k, *v) for k, v in want.items()}


def test_odd_rows(spark, ledger):
    counts = count_tokens(odd_docs(spark), {"w": None, "b": BPE})
    assert counts.count() == 2 * (len(ODD_TEXTS) + 3)
    events = counts.selectExpr("doc_id", "'insert' as op", "source", "lang", "tokenizer", "n_tokens")
    ledger.commit("x", events)
    assert sum(r.n_docs for r in ledger.totals().collect()) == 2 * (len(ODD_TEXTS) + 2)
    assert count_tokens(empty_docs(spark), {"w": None}).count() == 0
