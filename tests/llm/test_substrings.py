import random

import numpy as np

from marketloom.llm.substrings import Windows, _runs, _unfolded, intervals, remove_repeats
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs


def brute(docs, width):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((-1 if i is None else i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def found(df):
    rows = df.collect()
    for r in rows:
        assert sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed
        assert all(e < s for e, s in zip(r.ends, r.starts[1:]))
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows)


def test_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_random_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(40)}" for _ in range(600)]
    docs = []
    for i in range(120):
        at, n = rng.randrange(550), rng.randrange(60)
        words = base[at : at + n] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(8))] + base[: rng.randrange(30)]
        docs.append((rng.randrange(100), " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (5, 13):
        assert found(remove_repeats(frame, width)) == brute(docs, width)


def test_hashes_depend_on_the_words_alone():
    words = [f"w{i}" for i in range(100)]
    w = Windows([" ".join(words).encode(), b"", b"  x y\tz " + " ".join(words[20:]).encode(), b"few"], 13)
    assert list(w.counts) == [100, 0, 83, 1]
    lanes = w.hashed(w.word, w.word + 13)
    for lane in (*lanes, w.anchors()):
        left, right = lane[w.text == 0], lane[w.text == 2]
        assert list(left[20:]) == list(right[3:])
    assert all(len(set(lane[w.text == 0])) == 88 for lane in lanes)
    least, most = intervals(100, np.array([3, 10, 60]), 13)
    assert list(least) == [3, 60] and list(most) == [23, 73]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = found(remove_repeats(docs))
    assert len(rows) == len(ODD_TEXTS) + 3 and rows == brute([(r.doc_id, r.text) for r in docs.collect()], 13)
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_runs():
    row = np.array([0, 0, 0, 2, 2, 3] + [5] * 10_000)
    value = np.array([4, 5, 9, 10, 11, 12, *range(10_000)])
    rows, runs = _runs(row, value)
    back = [(r, v) for r, run in zip(rows, runs) for v in _unfolded([int(run)])]
    assert back == list(zip(row, value)) and len(runs) == 4 + 3
    assert list(_unfolded(None)) == []


def test_repeats_inside_texts_and_of_ids(spark):
    rng = random.Random(8)
    line = " ".join(f"w{i}" for i in range(9))
    docs = [(i, " ".join([line] * rng.randrange(1, 60) + [f"u{i}"] + [line] * rng.randrange(30))) for i in range(30)]
    docs += [(i, "word " * (3000 + i)) for i in (50, 51, 51)] + [(60, " ".join(f"v{k}" for k in range(9000)))] * 2 + [(61, " ".join(f"v{k}" for k in range(3, 8990)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert found(remove_repeats(frame)) == brute(docs, 13)


def test_a_repeated_id_hides_no_passage(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    # two batches: in the first, document 3 alone holds the passage; in the second, another text of 3 and document 7
    parts = [[(3, f"{passage} a")], [(3, f"b {passage}"), (7, f"c {passage} d")]]
    frames = [spark.createDataFrame(p, "doc_id long, text string").coalesce(1) for p in parts]
    rows = found(remove_repeats(frames[0].unionByName(frames[1])))
    assert rows == brute([r for p in parts for r in p], 13) and rows[-1][2] == 40


def test_runs_of_long_texts_are_folded(spark):
    from marketloom.llm.substrings import RUN, _folded

    places = [*range(10_000), 10_500, *range(20_000, 20_010)]
    values = [p * RUN + 1 for p in places] + [30_000 * RUN + 4000, 34_000 * RUN + 7]
    frame = spark.createDataFrame([(1, 2, v) for v in values], "doc_id long, row long, at long")
    runs = _folded(frame, "at").first()["at"]
    assert sorted(_unfolded(runs)) == [*places, *range(30_000, 34_007)] and len(runs) < 12
