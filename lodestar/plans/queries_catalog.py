"""Queries of the catalog, the audit log and the sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import day, minute, percent
from lodestar.operators import catalog, history
from lodestar.plans import inputs
from lodestar.plans.inputs import AUDIT_SQL, CHUNKS_SQL, FILES_SQL, NL, TURNS_SQL, table
from lodestar.plans.registry import query

_NOW = datetime(2024, 6, 1)


@query("group_listing", f"""WITH {FILES_SQL}, g AS (SELECT unnest(string_split(groups, '|')) AS "group", file_md5, file_name, groups FROM files)
SELECT "group", file_md5, file_name, CAST(row_number() OVER (PARTITION BY "group" ORDER BY groups, file_name, file_md5) AS INTEGER) AS pos, "group" = 'default' AS is_default FROM g""")
def group_listing(spark, sf_dir):
    return catalog.grouped(inputs.files(spark, sf_dir)).select("group", "file_md5", "file_name", "pos", "is_default")


@query("group_toggle", f"""WITH {FILES_SQL} SELECT file_md5, groups, CASE WHEN groups = 'EN' OR groups ILIKE 'en|%' OR groups ILIKE '%|en|%' OR groups ILIKE '%|en' THEN false ELSE is_enabled END AS is_enabled FROM files""")
def group_toggle(spark, sf_dir):
    return catalog.set_group_enabled(inputs.files(spark, sf_dir), "EN", False)[0].select("file_md5", "groups", "is_enabled")


@query("group_toggle_audit", f"""WITH {FILES_SQL} SELECT 'update' AS op_type, '启用分组: src1' AS op_detail, file_name, file_md5, total_chunks AS chunk_count, 'success' AS op_result FROM files WHERE groups LIKE 'src1|%'""")
def group_toggle_audit(spark, sf_dir):
    return catalog.set_group_enabled(inputs.files(spark, sf_dir), "src1", True)[1].drop("op_time")


@query("status_totals", f"WITH {FILES_SQL} SELECT count(*) * 2 AS docs, CAST(sum(total_chunks) * 2 AS BIGINT) AS chunks FROM files")
def status_totals(spark, sf_dir):
    return catalog.status_totals(inputs.files(spark, sf_dir))


@query("overview", f"""WITH RECURSIVE {CHUNKS_SQL}, {FILES_SQL}
SELECT count(*) AS total_docs, count_if(is_enabled) AS enabled_docs, CAST(sum(total_chunks) AS BIGINT) AS total_chunks, (SELECT CAST(sum(length) AS BIGINT) FROM chunks) AS total_chars,
  max(indexed_at) AS latest_index, 1024 AS embedding_dim, CAST(-1 AS BIGINT) AS storage_bytes FROM files""")
def overview(spark, sf_dir):
    return catalog.overview(inputs.files(spark, sf_dir), inputs.chunks(spark, sf_dir), 1024)


@query("overview_format", f"""WITH {FILES_SQL} SELECT groups, CAST(round_even(count_if(is_enabled) * 100.0 / count(*), 0) AS INTEGER) AS enabled_percent, strftime(max(indexed_at), '%Y-%m-%d %H:%M') AS latest, strftime(min(indexed_at), '%Y-%m-%d') AS first_day FROM files GROUP BY groups""")
def overview_format(spark, sf_dir):
    rows = inputs.files(spark, sf_dir).groupBy("groups").agg(F.count_if("is_enabled").alias("e"), F.count("*").alias("n"), F.max("indexed_at").alias("latest"), F.min("indexed_at").alias("first"))
    return rows.select("groups", percent(F.col("e"), F.col("n")).alias("enabled_percent"), minute(F.col("latest")).alias("latest"), day(F.col("first")).alias("first_day"))


@query("enabled_ids", f"WITH {FILES_SQL} SELECT file_md5 FROM files WHERE is_enabled")
def enabled_ids(spark, sf_dir):
    return inputs.files(spark, sf_dir).where("is_enabled").select("file_md5")


@query("insert_ignore", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_ignore(spark, sf_dir):
    """All documents into a table that has the labelled ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return catalog.insert_ignore(rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), rows, "doc_id").select("doc_id", "lang", "source")


@query("delete_doc", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_doc(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return catalog.delete(rows, table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query("delete_audit", f"WITH {FILES_SQL} SELECT 'delete' AS op_type, file_name AS op_detail, file_name, file_md5, total_chunks AS chunk_count, 'success' AS op_result FROM files WHERE NOT is_enabled")
def delete_audit(spark, sf_dir):
    return catalog.audit_rows("delete", F.col("file_name"), inputs.files(spark, sf_dir).where("not is_enabled"), now=_NOW).drop("op_time")


def _updates(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file_md5"), F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("")).alias("value"))


@query("update_fields", f"WITH {FILES_SQL} SELECT file_md5, CASE WHEN toxic = 1 THEN 'toxic' ELSE tags END AS tags FROM files LEFT JOIN labels ON CAST(doc_id AS VARCHAR) = file_md5")
def update_fields(spark, sf_dir):
    return catalog.set_field(inputs.files(spark, sf_dir), _updates(spark, sf_dir), "tags")[0].select("file_md5", "tags")


@query("update_audit", f"WITH {FILES_SQL} SELECT file_md5, 'tags: 空 → ' || CASE WHEN toxic = 1 THEN 'toxic' ELSE '空' END AS op_detail, total_chunks AS chunk_count FROM files JOIN labels ON CAST(doc_id AS VARCHAR) = file_md5")
def update_audit(spark, sf_dir):
    return catalog.set_field(inputs.files(spark, sf_dir), _updates(spark, sf_dir), "tags")[1].select("file_md5", "op_detail", "chunk_count")


@query("edit_save", f"WITH {FILES_SQL} SELECT file_md5, toxic = 1 AS changed FROM files JOIN labels ON CAST(doc_id AS VARCHAR) = file_md5")
def edit_save(spark, sf_dir):
    return inputs.files(spark, sf_dir).join(_updates(spark, sf_dir), "file_md5").select("file_md5", catalog.edited(F.col("tags"), F.col("value")).alias("changed"))


@query("audit_append", f"""WITH {AUDIT_SQL}, {FILES_SQL}, n AS (SELECT (SELECT max(id) FROM audit) + row_number() OVER (ORDER BY file_md5, file_name) AS id, 'delete' AS op_type, file_md5 FROM files WHERE NOT is_enabled),
a AS (SELECT id, op_type, file_md5 FROM audit UNION ALL SELECT * FROM n) SELECT id, op_type, file_md5 FROM a WHERE id IN (SELECT id FROM a ORDER BY id DESC LIMIT 5000)""")
def audit_append(spark, sf_dir):
    new = catalog.audit_rows("delete", F.col("file_name"), inputs.files(spark, sf_dir).where("not is_enabled"), now=_NOW).select("op_type", "op_detail", "file_md5", "op_time")
    return catalog.append_audit(inputs.audit(spark, sf_dir), new, 5000).select("id", "op_type", "file_md5")


@query("audit_rolling", f"WITH {AUDIT_SQL} SELECT id, op_type, file_md5 FROM audit ORDER BY id DESC LIMIT 5000")
def audit_rolling(spark, sf_dir):
    return catalog.rolling(inputs.audit(spark, sf_dir), 5000).select("id", "op_type", "file_md5")


@query("audit_range", f"WITH {AUDIT_SQL} SELECT id, op_type, op_time FROM audit WHERE id BETWEEN 100 AND 140 ORDER BY id DESC LIMIT 50")
def audit_range(spark, sf_dir):
    return catalog.audit_range(inputs.audit(spark, sf_dir), 100, 140).select("id", "op_type", "op_time")


@query("audit_latest", f"WITH {AUDIT_SQL} SELECT id, op_type, op_time FROM audit ORDER BY op_time DESC, id DESC LIMIT 50")
def audit_latest(spark, sf_dir):
    return catalog.audit_range(inputs.audit(spark, sf_dir)).select("id", "op_type", "op_time")


@query("audit_stats", f"WITH {AUDIT_SQL} SELECT min(id) AS min_id, max(id) AS max_id, count(*) AS total FROM audit")
def audit_stats(spark, sf_dir):
    return catalog.audit_stats(inputs.audit(spark, sf_dir))


_SESSIONS = "ss AS (SELECT session_id, left(arg_min(query, turn_no), 40) AS title, count(*) AS turn_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, min(created_at) AS created_at, max(created_at) AS updated_at FROM turns GROUP BY session_id)"


@query("sessions", f"WITH {TURNS_SQL}, {_SESSIONS} SELECT * FROM ss")
def sessions(spark, sf_dir):
    return history.sessions(inputs.turns(spark, sf_dir))


@query("session_list", f"WITH {TURNS_SQL}, {_SESSIONS} SELECT session_id, title, updated_at FROM ss ORDER BY updated_at DESC, session_id LIMIT 30")
def session_list(spark, sf_dir):
    return history.session_list(history.sessions(inputs.turns(spark, sf_dir))).select("session_id", "title", "updated_at")


@query("session_restore", f"WITH {TURNS_SQL} SELECT session_id, CAST(count(*) AS INTEGER) AS n, string_agg(turn_no || ':' || answer || ':' || query, {NL} ORDER BY turn_no) AS messages FROM turns GROUP BY session_id")
def session_restore(spark, sf_dir):
    rows = history.restore(inputs.turns(spark, sf_dir))
    return rows.select("session_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["turn_no"].cast("string"), m["answer"], m["query"])), "\n").alias("messages"))


@query("session_append", f"WITH {TURNS_SQL} SELECT session_id, CAST((SELECT max(turn_no) FROM turns t WHERE t.session_id = u.session_id) + row_number() OVER (PARTITION BY session_id ORDER BY created_at, query) AS INTEGER) AS turn_no, query FROM turns u")
def session_append(spark, sf_dir):
    """Every turn once more, after the ones its session has."""
    rows = inputs.turns(spark, sf_dir)
    return history.next_turns(rows, rows.drop("turn_no")).select("session_id", "turn_no", "query")


@query("session_delete", f"WITH {TURNS_SQL} SELECT session_id, turn_no FROM turns WHERE session_id NOT IN (SELECT session_id FROM turns WHERE answer = 'system')")
def session_delete(spark, sf_dir):
    rows = inputs.turns(spark, sf_dir).select("session_id", "turn_no")
    return catalog.delete(rows, rows.where("answer = 'system'"), "session_id")


@query("token_split", f"WITH {TURNS_SQL} SELECT session_id, CAST(coalesce(sum(CASE WHEN answer <> 'system' THEN input_tokens + output_tokens END), 0) AS BIGINT) AS search_tokens, CAST(coalesce(sum(CASE WHEN answer = 'system' THEN input_tokens + output_tokens END), 0) AS BIGINT) AS index_tokens FROM turns GROUP BY session_id")
def token_split(spark, sf_dir):
    rows = inputs.turns(spark, sf_dir).withColumn("kind", F.when(F.col("answer") == "system", F.lit("index")).otherwise(F.lit("search")))
    return history.token_split(rows)


@query("export_markdown", f"""WITH {TURNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no) AS i FROM turns)
SELECT session_id, '# 对话导出' || {NL} || {NL} || '- 会话 ID: ' || session_id || {NL} || '- 轮数: ' || count(*) || {NL} || {NL} || string_agg('## 第 ' || i || ' 轮' || {NL} || {NL} || '**问：** ' || query || {NL} || {NL} || '**答：** ' || answer || {NL} || {NL} ||
  CASE WHEN turn_no % 3 = 0 THEN '' ELSE '**来源引用：**' || {NL} || '- ' || answer || ' — 页码 [' || turn_no || '] — chunk #' || turn_no || CASE WHEN turn_no % 2 = 0 THEN ' — LLM得分=7' ELSE '' END || {NL} || {NL} END ||
  '**Tokens：** ' || input_tokens || '/' || output_tokens || {NL}, {NL} ORDER BY turn_no) AS markdown FROM k GROUP BY session_id""")
def export_markdown(spark, sf_dir):
    return history.export_markdown(inputs.turns(spark, sf_dir))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """The windows of the event stream, over all that has come so far."""
    from lodestar.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))
