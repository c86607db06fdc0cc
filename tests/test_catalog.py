from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import catalog, history

NOW = datetime(2024, 1, 2, 3, 4)
KIND = "file_md5 string, file_name string, groups string, tags string, total_chunks long, is_enabled boolean, indexed_at timestamp_ntz"


def files(spark):
    rows = [("1", "b.txt", "default", "", 3, True, NOW), ("2", "a.txt", "aaa|zzz", "t", 2, False, NOW), ("3", "c.txt", "default", "", 0, True, datetime(2025, 1, 1)), ("4", "d.txt", "x|a_b", "", 1, True, NOW), ("5", "e.txt", "x|aXb", "", 1, True, NOW)]
    return spark.createDataFrame(rows, KIND)


def test_groups(spark):
    got = catalog.grouped(files(spark)).orderBy(F.col("is_default").desc(), "group", "pos").collect()
    assert [(r.group, r.file_md5) for r in got if r.group in ("default", "aaa", "zzz")] == [("default", "1"), ("default", "3"), ("aaa", "2"), ("zzz", "2")]
    assert catalog.status_totals(files(spark)).first().asDict() == {"docs": 8, "chunks": 11}


@pytest.mark.parametrize(("name", "hit"), [("a_b", {"4"}), ("default", {"1", "3"}), ("Default", set()), ("ZZZ", {"2"}), ("aa", set()), ("x", {"4", "5"}), ("%", set())])
def test_group_match(spark, name, hit):
    new, rows = catalog.set_group_enabled(files(spark), name, False)
    assert {r.file_md5 for r in rows.collect()} == hit
    assert {r.file_md5 for r in new.where("not is_enabled").collect()} == hit | {"2"}


def test_updates(spark):
    new, rows = catalog.set_field(files(spark), spark.createDataFrame([("1", "new"), ("2", ""), ("9", "x")], "file_md5 string, value string"), "tags")
    assert {r.file_md5: r.tags for r in new.collect()}["1"] == "new" and new.count() == 5
    assert {r.op_detail for r in rows.collect()} == {"tags: 空 → new", "tags: t → 空"}


def test_insert_ignore_and_delete(spark):
    new = spark.createDataFrame([("1", "again"), ("7", "b"), ("7", "a")], "k string, v string")
    old = spark.createDataFrame([("1", "old")], "k string, v string")
    assert [(r.k, r.v) for r in catalog.insert_ignore(old, new, "k").collect()] == [("7", "a")]
    assert catalog.delete(old, new, "k").count() == 0


def audit(spark, n):
    return spark.createDataFrame([(i, "op", "", None, str(i), 0, "success", NOW) for i in range(1, n + 1)], "id long, op_type string, op_detail string, file_name string, file_md5 string, chunk_count long, op_result string, op_time timestamp_ntz")


def test_audit(spark):
    log = catalog.rolling(audit(spark, 6), 3)
    assert sorted(r.id for r in log.collect()) == [4, 5, 6]
    assert catalog.audit_range(log, 1, 3).count() == 0 and [r.id for r in catalog.audit_range(log).collect()] == [6, 5, 4]
    more = catalog.append_audit(log, catalog.audit_rows("add", F.lit("x"), files(spark).limit(2), now=NOW), 4)
    assert sorted(r.id for r in more.collect()) == [5, 6, 7, 8]
    assert catalog.audit_stats(audit(spark, 0)).first().asDict() == {"min_id": 0, "max_id": 0, "total": 0}
    assert catalog.check_range(5, 3) and catalog.check_range(1, 52) and catalog.check_range(1, 51) is None and catalog.latest_range(1, 100) == (51, 100)


def test_overview(spark):
    chunks = spark.createDataFrame([("ab",), ("c",)], "text string")
    row = catalog.overview(files(spark), chunks, 64).first()
    assert (row.total_docs, row.enabled_docs, row.total_chunks, row.total_chars, row.latest_index) == (5, 4, 7, 3, NOW)


def test_edit(spark):
    df = spark.createDataFrame([("a", ""), ("a", "a"), ("a", "b"), (None, "b")], "o string, n string")
    assert [r[0] for r in df.select(catalog.edited(F.col("o"), F.col("n"))).collect()] == [False, False, True, True]


TURN = "session_id string, turn_no int, query string, answer string, sources array<struct<doc_name:string,page_nums:array<int>,chunk_index:int,chapter_title:string,llm_score:int>>, input_tokens long, output_tokens long, elapsed_ms long, created_at timestamp_ntz"


def turns(spark):
    return spark.createDataFrame([("s", 1, "q" * 60, "a", [("d", [3], 5, "", 7)], 1, 2, 10, NOW), ("s", 2, "again", "b", [], 3, 4, 20, datetime(2024, 2, 1)), ("r", 1, "x", "y", [], 0, 0, 0, NOW)], TURN)


def test_sessions(spark):
    row = history.sessions(turns(spark)).where("session_id = 's'").first()
    assert (row.title, row.turn_count, row.input_tokens, row.output_tokens, row.elapsed_ms, row.updated_at) == ("q" * 40, 2, 4, 6, 30, datetime(2024, 2, 1))
    assert [r.session_id for r in history.session_list(history.sessions(turns(spark))).collect()] == ["s", "r"]
    assert [m.turn_no for m in history.restore(turns(spark), "s").first().messages] == [1, 2] and history.restore(turns(spark), "none").count() == 0
    new = history.next_turns(turns(spark), turns(spark).drop("turn_no").withColumn("session_id", F.when(F.col("session_id") == "r", "new").otherwise(F.col("session_id"))))
    assert sorted((r.session_id, r.turn_no) for r in new.collect()) == [("new", 1), ("s", 3), ("s", 4)]


def test_export(spark):
    text = history.export_markdown(turns(spark)).where("session_id = 's'").first().markdown
    assert text.startswith("# 对话导出\n\n- 会话 ID: s\n- 轮数: 2\n\n## 第 1 轮\n\n**问：** qqq") and "- d — 页码 [3] — chunk #5 — LLM得分=7\n" in text and text.endswith("**Tokens：** 3/4\n")


def test_malformed_messages(spark):
    df = spark.createDataFrame([('[{"query":"q"}]',), ("{bad",), (None,)], "t string")
    assert [len(r[0]) for r in df.select(history.parse_messages(F.col("t"), "struct<query:string>")).collect()] == [1, 0, 0]


def test_formats(spark):
    df = spark.createDataFrame([(999,), (10_000,), (123_456,), (1 << 20,), (1280,), (3 << 30,)], "n long")
    assert [r[0] for r in df.select(T.chars_display(F.col("n"))).collect()][:3] == ["999 字符", "1.0 万字符", "12.3 万字符"]
    assert [r[0] for r in df.select(T.bytes_display(F.col("n"))).collect()] == ["999 B", "9.8 KB", "120.6 KB", "1.0 MB", "1.2 KB", "3.00 GB"]
    assert df.limit(1).select(T.percent(F.lit(1), F.lit(8)), T.percent(F.lit(1), F.lit(0))).first() == (12, None)
    assert df.limit(1).select(T.strip(F.lit("　 a ")), T.document_name(F.lit("/x/y.PDF")), T.document_name(F.lit("z.txt"))).first() == ("a", "y", "z.txt")
