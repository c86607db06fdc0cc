"""Chat formatting against its SQL, also over awkward turns."""

import duckdb

from lodestar.llm import chat_format

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "user", None),
    (2, None, "assistant", "first"), (2, 5, None, "nameless"), (2, 6, "user", ""), (2, 6, "user", ""),
    (None, 1, "user", "x"), (None, 2, "user", "y"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "also"), (3, 1, "user", "tie"),
    (4, 1, "user", "long " * 50_000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def _rows(df, columns):
    return sorted(map(tuple, df.select(columns).collect()), key=str)


def test_against_sql(spark, tmp_path):
    columns = ["conv_id", "n_turns", "n_messages", "chat"]
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/c")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/c/*.parquet'")
    want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({chat_format.ORACLE})").fetchall(), key=str)
    assert _rows(chat_format.format_chats(spark.read.parquet(f"{tmp_path}/c")), columns) == want


def test_merges_neighbours(spark):
    found = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert found[1].chat.startswith("<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\na\n\nb<|im_end|>\n")
    assert (found[1].n_turns, found[1].n_messages) == (5, 4)
    assert found[2].chat == "<|im_start|>assistant\nfirst<|im_end|>\n<|im_start|>user\nnameless\n\n\n\n<|im_end|>\n"
    assert len(found[4].chat) > 250_000


def test_long_conversation(spark):
    n = 30_000
    turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id div 3 % 2 = 0, 'user', 'assistant') as role", "cast(id as string) as text")
    found = chat_format.format_chats(turns).collect()
    assert (found[0].n_turns, found[0].n_messages) == (n, n // 3)
    assert found[0].chat.startswith("<|im_start|>user\n0\n\n1\n\n2<|im_end|>\n<|im_start|>assistant\n3")


def test_clashing_columns_and_empty(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA + ", turns string")
    columns = ["conv_id", "n_turns", "n_messages", "chat"]
    assert _rows(chat_format.format_chats(rows), columns) == _rows(chat_format.format_chats(rows.drop("turns")), columns)
    assert chat_format.format_chats(rows.limit(0)).collect() == []
