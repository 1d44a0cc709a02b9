import time

from marketloom.llm.chats import format_chats


def brute(rows):
    convs = {}
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for r in sorted({tuple(r) for r in rows if r[0] is not None}, key=lambda r: (r[0], key(r))):
        convs.setdefault(r[0], []).append(r[2:])
    out = set()
    for c, turns in convs.items():
        same = [d for d, t in convs.items() if t == turns]
        longer = any(len(t) > len(turns) and t[: len(turns)] == turns for t in convs.values())
        if c == min(same) and not longer:
            out.add((c, len(turns), len(same), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)))
    return out


def found(df):
    return {tuple(r) for r in df.collect()}


def test_every_conversation(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert found(format_chats(table)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"),
        (2, 0, "user", "a"),
        (3, 5, "user", "a"), (3, 9, "assistant", "b"),
        (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", None),
        (5, None, None, None), (6, 0, "", ""), (7, 0, "user", "x" * 100_000),
        (None, 0, "user", "lost"), (8, 0, "use", "ra"), (9, 0, "user", "a"), (9, 0, "assistant", "b"),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = found(format_chats(table))
    assert got == brute(rows) and {r[0] for r in got} == {4, 5, 6, 7, 8, 9}
    assert format_chats(table.limit(0)).count() == 0


def test_a_long_conversation(spark):
    turns = spark.range(50_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    table = turns.unionByName(turns.filter("turn < 49000").selectExpr("2L as conv_id", "turn", "role", "text"))
    began = time.monotonic()
    got = format_chats(table).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 50_000)] and got[0].text.endswith("turn 49999<|im_end|>\n")
    assert time.monotonic() - began < 60
