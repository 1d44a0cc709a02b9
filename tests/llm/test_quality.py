import math
import re
import struct

import pytest
import xxhash

from marketloom.llm.quality import ALPHA, CUT_SHARE, THRESHOLD, score_quality
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs

B = 500


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hashes(words):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    pack = lambda x: struct.pack("<q", x)
    return h + [signed(xxhash.xxh64_intdigest(pack(b), xxhash.xxh64_intdigest(pack(a), 42))) for a, b in zip(h, h[1:])]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, trusted):
    raw, target = [0] * B, [0] * B
    for i, text in docs:
        for h in hashes(words_of(text)):
            raw[h % B] += 1
            target[h % B] += i in trusted
    r, t = sum(raw), sum(target)
    w = [math.log((y + ALPHA) / (t + ALPHA * B)) - math.log((x + ALPHA) / (r + ALPHA * B)) if t else 0.0 for x, y in zip(raw, target)]
    out = {}
    for i, text in docs:
        words, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
        seen, covered = {}, set()
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                covered |= {k + j for k in at for j in range(8)}
        h = hashes(words)
        llr = sum(w[x % B] for x in h) / len(h) if h else 0.0
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        out.setdefault(i, []).append((*counts, round(llr, 9), failed, not failed and llr >= THRESHOLD))
    return out


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, round(r.llr, 9), r.base_failed, r.kept))
    return {k: sorted(v) for k, v in out.items()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(sorted(a[k]), sorted(b[k]), strict=True):
            assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-7 and x[6:] == y[6:], (k, x, y)


def test_every_document(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    close(rows(score_quality(docs, labels, buckets=B)), brute([(r.doc_id, r.text) for r in docs.collect()], trusted))


def test_the_bound_on_trusted_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    few, many = (rows(score_quality(docs, labels, buckets=B, target_docs=n)) for n in (5, 10**6))
    assert few != many and rows(score_quality(docs.repartition(5), labels, buckets=B, target_docs=5)).keys() == few.keys()


def test_odd_rows(spark):
    labels = spark.createDataFrame([(11, 1, 0), (11, 1, 0), (8, 1, None), (None, 1, 0), (2, 0, None)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    got = rows(score_quality(docs, labels, buckets=B))
    close(got, brute([(r.doc_id, r.text) for r in docs.collect()], {11, 8}))
    assert sum(map(len, got.values())) == len(ODD_TEXTS) + 3
    assert score_quality(empty_docs(spark), labels).count() == 0
    plain = score_quality(docs, labels.limit(0)).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in plain)


def test_the_cut_is_a_quantile_of_the_trusted_documents_left_out_of_the_model(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    own = []
    for i in trusted:
        by_id = {k: v[0] for k, v in brute(texts, trusted - {i}).items() if k == i}
        own += [v[5] for v in by_id.values() if not v[6]]
    own.sort()
    at = CUT_SHARE * (len(own) - 1)
    cut = own[int(at)] + (at - int(at)) * (own[int(at) + 1] - own[int(at)])
    for r in score_quality(docs, labels, threshold=None, buckets=B).collect():
        assert abs(r.llr - cut) < 1e-7 or r.kept == (not r.base_failed and r.llr >= cut)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_bad_documents_go_and_clean_ones_stay(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels, threshold=None).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    bad, clean = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(bad) <= 0.02 * len(bad) and sum(clean) >= 0.98 * len(clean)


def test_all_trusted_documents_count(spark):
    from pyspark.sql import functions as F

    from marketloom.llm.quality import bin_counts, trusted_cut, trusted_ids

    labels = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert trusted_ids(labels).count() == 25_000
    docs = spark.range(101).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 30), i -> concat('w', i * id)), ' ')").alias("text"))
    trusted = trusted_ids(labels)
    counts = bin_counts(docs, trusted, buckets=50)
    counts = spark.createDataFrame(counts.collect(), counts.schema)
    cuts = [trusted_cut(docs, trusted, counts, 50, share) for share in (0.0, 0.25, 0.255, 0.5, 1.0)]
    assert cuts == sorted(cuts) and len(set(cuts)) == 5


def test_texts_of_documents_not_trusted_stay_where_they_are(spark):
    from pyspark.sql import functions as F

    from marketloom.llm.quality import trusted_texts

    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(docs.filter("doc_id = 30")).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text"))
    trusted = spark.range(0, 2000, 10).select(F.col("id").cast("int").alias("doc_id"))
    mine = trusted_texts(docs, trusted)
    assert sorted(r.text for r in mine.collect()) == sorted([f"text {i}" for i in range(0, 1000, 10)] + ["text 30"])
    plan = mine._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftSemi") :]
    assert "getbit" in below and "shuffle_hash" in below
