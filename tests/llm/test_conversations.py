import hashlib

from helpers_llm import with_clashes

from waypost.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def test_as_sql(spark, compare):
    d = "/root/testdata/sf0.001"
    compare(C.op3_chat(spark, d), C.ORACLE, d)


def brute(rows):
    convs = {}
    for i, (c, turn, role, text) in enumerate(rows):
        convs.setdefault(c if c is not None else f"alone {i}", []).append((turn is not None, turn or 0, hashlib.md5(f"{'0' if role is None else '1' + role}\n{'0' if text is None else '1' + text}".encode()).digest(), role, text))
    told = {c: tuple((r, t) for _, _, _, r, t in sorted(v, key=lambda x: x[:3])) for c, v in convs.items()}
    kept = {}
    for c, turns in told.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in told.values()):
            kept.setdefault(turns, []).append(c)
    show = lambda turns: "".join(f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in turns)
    return sorted((min([i for i in c if isinstance(i, int)], default=-1), len(t), len(c), show(t)) for t, c in kept.items())


def told(df):
    return sorted((-1 if r["conv_id"] is None else r["conv_id"], *tuple(r)[1:]) for r in df.collect())


ROWS = [
    (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"), (4, 1, "assistant", "hello"), (4, 0, "user", "hi"), (4, 2, "user", "more"), (5, 0, "user", "hi"), (5, 1, "assistant", "other"),
    (6, 0, None, None), (7, 0, "", ""), (8, None, "user", "first"), (8, 0, "user", "second"), (None, 0, "user", "lonely"), (None, 1, "user", "lonely too"), (9, 0, "user", "x" * 50_000), (10, 0, "user", "hello"), (11, 0, "user", "hi"), (11, 1, "user", "hello"),
]


#: Ties of a turn's number, nulls, turns without id, repeated and equal to others' conversations.
TIES = [(20, 0, "user", "b"), (20, 0, "user", "a"), (20, 0, None, "a"), (20, 0, "user", None), (21, None, "user", "z"), (21, None, "user", "y"), (22, 0, "user", "same"), (None, 4, "user", "same"), (None, 9, "user", "same"), (None, 0, "user", "twice"), (None, 0, "user", "twice"), (None, None, None, None), (None, 0, "user", "hi"), (None, 3, "", "")]


def test_odd_cases(spark):
    for rows in (ROWS, ROWS + TIES, TIES + TIES):
        assert told(C.format_chats(with_clashes(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_odd_cases_as_sql(spark, tmp_path):
    import duckdb

    rows = ROWS + TIES + TIES[:3]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/c")
    found = duckdb.sql(f"WITH conversations AS (SELECT * FROM '{tmp_path}/c/*.parquet') SELECT conv_id, n_turns, n_copies, text FROM ({C.ORACLE})").fetchall()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found) == told(C.format_chats(spark.createDataFrame(rows, SCHEMA)))


def test_many_snapshots_and_empty(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(c + 1)] + [(1000 + c, 0, "user", f"turn {0 if c % 2 else c}") for c in range(20)]
    assert told(C.format_chats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    repeated = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "b")]
    assert [r["n_turns"] for r in C.format_chats(spark.createDataFrame(repeated, SCHEMA)).collect()] == [3]
