from fractions import Fraction

import numpy as np

from marketloom.llm.components import components
from marketloom.llm.jaccard import common_counts, near_duplicates
from marketloom.llm.shingles import chosen_bands
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs


def brute(texts):
    """Class, group and links of every document by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                common = len(a & b)
                if 5 * common >= 4 * (len(a) + len(b) - common):
                    links[i].add(j)
                    links[j].add(i)
    group = {}
    for i in ids:
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += links[x]
    same = {i: min([i, *(j for j in links[i] if sets[j] == sets[i])]) for i in ids}
    return {(i, same[i], group[i], len(links[i])) for i in ids}


def found(df):
    return {(r.doc_id, r.class_id, r.group_id, r.n_links) for r in df.collect()}


def test_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(near_duplicates(docs)) == brute({r.doc_id: r.text for r in docs.collect()})


def test_a_group_in_many_blocks(spark, monkeypatch):
    from marketloom.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    words = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        own = list(words)
        own[(i * 7) % 110] = f"x{i}"
        if i % 3 == 0:
            own[(i * 11) % 110] = f"y{i}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(near_duplicates(docs)) == brute(texts)


def test_links_of_a_pair_count_once_and_only_band_sharers_are_compared(spark):
    from marketloom.llm import jaccard

    mine = lambda *bands: [{"band": b, "nb": 1, "block": 0} for b in bands]
    rows = [{"mine": mine(1, 5)}, {"mine": mine(1, 5)}, {"mine": mine(5)}]
    assert jaccard._seen(rows, 5, 0).tolist() == [[True, True, False], [True, True, False], [False, False, False]]
    # a chain: neighbours are near, the ends are not; every link counts once, whatever buckets they share
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[i * 12 : i * 12 + 200]) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(near_duplicates(docs)) == brute(texts)


def test_rows_of_one_id_are_told_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b + " more"), (3, a)], "doc_id long, text string")
    rows = near_duplicates(docs).select("doc_id", "text_hash", "n_links", "stays").collect()
    assert sorted((r.doc_id, r.n_links, r.stays) for r in rows) == [(1, 1, True), (1, 2, True), (1, 2, True), (2, 1, False), (3, 2, False)]


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(70)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = common_counts(sets, 0)
    off = ~np.eye(70, dtype=bool)
    assert (got[off] == want[off]).all()
    assert (common_counts(sets, 30) == want[:30, 30:]).all()


def test_bands():
    bands, rows = chosen_bands(0.8, 0.9995, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components(spark):
    pairs = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(41)}


def test_odd_rows(spark):
    rows = near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[9].class_id == 8 and by[8].n_links == 2 and by[0].n_links == 0 and by[1].group_id == 1
    assert all(r.group_id is None and r.n_links == 0 for r in rows if r.doc_id is None)
    assert near_duplicates(empty_docs(spark)).count() == 0
    assert near_duplicates(odd_docs(spark), threshold=Fraction(1, 2)).count() == len(rows)


def test_many_texts_and_repeated_rows_under_one_id(spark):
    """Near copies that share an id are told apart by their texts; rows that repeat both are one set, and copies of each other."""
    common = " ".join(f"w{i}" for i in range(60))
    rows = [(7, f"{common} tail{k}") for k in range(40)] * 3 + [(8, f"{common} tail0"), (9, "another text of some six words")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    near = [r for r in found if r["doc_id"] != 9]
    assert len(found) == len(rows) and {r["n_links"] for r in near} == {120} and {r["group_id"] for r in near} == {7}
    assert len({r["text_hash"] for r in near if r["stays"]}) == 1
    assert [(r["n_links"], r["stays"]) for r in found if r["doc_id"] == 9] == [(0, True)]
