import random

import numpy as np
import pytest

from marketloom.llm.mixing import Schedule, mix_sources, period
from tests.llm.helpers import empty_docs, odd_docs


@pytest.mark.parametrize("parts", [{"a": 1}, {"a": 3, "b": 2, "c": 7}, {f"s{i}": 1 + i % 5 for i in range(40)}, {"x": 97, "y": 1, "z": 2}])
def test_a_period_deviates_by_less_than_a_block(parts):
    alike = {p: sum(x == p for x in parts.values()) for p in parts.values()}
    slots, q = {}, sum(parts.values())
    for (p, _), runs in period(alike).items():
        for rank, slot, many in runs:
            for k in range(many):
                slots.setdefault((p, rank + k), []).append(slot + k)
    assert sorted(x for s in slots.values() for x in s) == list(range(q))
    for (p, _), mine in slots.items():
        assert len(mine) == p
        for t in range(q + 1):
            assert abs(sum(x < t for x in mine) * q - t * p) < q


def order(sources):
    """The source and block of every slot, by the schedule; sources are (parts, blocks)."""
    names = range(len(sources))
    rank = {s: r for p in {p for p, _ in sources} for r, s in enumerate(sorted((s for s in names if sources[s][0] == p), key=lambda s: (-(sources[s][1] // p), s)))}
    left = lambda s: (sources[s][1] // sources[s][0], sources[s][1] % sources[s][0])
    place = {s: sum(left(t) == left(s) and (sources[t][0], t) < (sources[s][0], s) for t in names) for s in names}
    sizes = {}
    for s in sources:
        sizes[s] = sizes.get(s, 0) + 1
    schedule = Schedule(sizes)
    rows = [(p, n, rank[s], place[s], b) for s, (p, n) in enumerate(sources) for b in range(n)]
    slots = schedule.slots(*np.array(rows, np.int64).T)
    owner = [(s, b) for s, (_, n) in enumerate(sources) for b in range(n)]
    return [owner[k] for k in np.argsort(slots)], sorted(slots)


def test_every_source_stays_within_a_block_of_its_weight():
    rng = random.Random(4)
    cases = [[(3, 25), (2, 3), (5, 40)], [(1, 1)], [(7, 2), (1, 9)], [(1, n) for n in (5, 5, 2, 9, 1)]]
    cases += [[(rng.choice([1, 1, 1, 2, 3, 6]), rng.randrange(1, 30)) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    for sources in cases:
        stream, slots = order(sources)
        assert slots == list(range(sum(n for _, n in sources)))
        done, t, number = [0] * len(sources), 0, 0
        while t < len(stream):
            gives = [min(p, max(0, n - number * p)) for p, n in sources]
            q, start = sum(gives), list(done)
            for k in range(1, q + 1):
                s, b = stream[t]
                assert b == done[s]
                done[s] += 1
                t += 1
                assert all(abs((done[x] - start[x]) * q - k * gives[x]) < q for x in range(len(sources)))
            assert [d - x for d, x in zip(done, start)] == gives
            number += 1


def test_thousands_of_sources_and_large_weights(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "concat('s', cast(sqrt(id) * 20 as int)) as source")
    rows = mix_sources(docs, {"s1": 5}, block_rows=1).collect()
    assert sorted((r.slot, r.in_block) for r in rows) == [(k, 0) for k in range(40_000)]
    assert len({r.source for r in rows}) > 3_000
    rows = mix_sources(docs.limit(500), {"s0": 1_000_003, "s400": 3_000_017}, default_parts=999_983, block_rows=2).collect()
    assert len({(r.slot, r.in_block) for r in rows}) == 500


def test_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    rows = mix_sources(docs, {"src0": 3}, block_rows=4, bucket_rows=8).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    blocks = {}
    for r in rows:
        assert blocks.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(blocks) == list(range(len(blocks)))
    again = mix_sources(docs.repartition(7), {"src0": 3}, block_rows=4, bucket_rows=8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = mix_sources(docs, {}, block_rows=2).collect()
    assert len(rows) == docs.count() and {"doc_id", "text", "slot", "block", "in_block"} <= set(rows[0].asDict())
    assert len({(r.slot, r.in_block) for r in rows}) == len(rows)
    assert mix_sources(empty_docs(spark), {}).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 0})


def test_thousands_of_named_sources(spark):
    parts = {f"n{i}": 1 + i % 7 for i in range(5000)}
    docs = spark.range(12_000).selectExpr("id as doc_id", "'n' || id % 6000 as source")
    rows = mix_sources(docs, parts, block_rows=1).collect()
    assert sorted(r.slot for r in rows) == list(range(12_000))
    # in the first period every source gives as many blocks as it has parts, or both that it has
    first = sorted(rows, key=lambda r: r.slot)[: sum(min(2, parts.get(f"n{i}", 1)) for i in range(6000))]
    given = {}
    for r in first:
        given[r.source] = given.get(r.source, 0) + 1
    assert all(n == min(2, parts.get(s, 1)) for s, n in given.items()) and len(given) == 6000


def test_many_rows_without_an_id_or_of_one_are_dealt_out(spark):
    docs = spark.range(60_000).selectExpr("if(id % 3 = 0, id, if(id % 3 = 1, null, 7)) as doc_id", "if(id % 2 = 0, 'a', 'b') as source")
    mixed = mix_sources(docs, {"a": 2}, block_rows=8, bucket_rows=200).cache()
    places = [(r.slot, r.in_block) for r in mixed.select("slot", "in_block").collect()]
    assert len(set(places)) == 60_000 and max(places)[0] == 60_000 // 8 - 1
    assert mixed.filter("doc_id is null").count() == 20_000
    plan = mixed._jdf.queryExecution().toString()
    assert "mixing-" in plan  # rows are numbered in a written table


def test_columns_of_any_name_stay(spark):
    names = ["_n", "_parts", "_source", "_hash", "_bucket", "_offset", "_blocks", "_rank", "_place", "_row", "_id", "_block", "_own", "a.b", "c`d"]
    docs = spark.createDataFrame([(i, "s", *range(i, i + len(names))) for i in range(40)], ["doc_id", "source", *names])
    mixed = mix_sources(docs, {"s": 3})
    assert mixed.columns == [*docs.columns, "block", "slot", "in_block"]
    assert {tuple(r)[: len(docs.columns)] for r in mixed.collect()} == {tuple(r) for r in docs.collect()}


def test_ranks_of_sources_in_several_buckets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'s' || id % 900 as source")
    rows = mix_sources(docs, {"s1": 3, "s2": 2}, block_rows=2, bucket_rows=64).collect()
    blocks = {(r.source, r.block): r.slot for r in rows}
    assert sorted(blocks.values()) == list(range(len(blocks)))
