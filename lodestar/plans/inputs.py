"""How the generated tables stand for the engine's own: documents as files, pages and stored chunks, events as an audit log, conversations as sessions.

Every mapping is there twice, as a DataFrame and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import lines
from lodestar.operators.chunking import by_paragraphs
from lodestar.schemas import SOURCE

CHUNK = 500
NL = "chr(10)"
BLANKS = "chr(10) || chr(9) || chr(13) || ' '"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_paragraphs(table(spark, sf_dir, "documents"), CHUNK, "\n")


def fold_sql(limit: int, own: int, where: str = "text IS NOT NULL") -> str:
    """CTEs p, f: lines of documents with the number of the chunk that a greedy fold puts them in."""
    add = f"(length(p.para) + {own})"
    return f"""p AS (SELECT doc_id, unnest(string_split(text, {NL})) AS para, generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents WHERE {where}),
f AS (SELECT doc_id, i, para, length(para) + {own} AS size, 0 AS grp FROM p WHERE i = 1
      UNION ALL
      SELECT p.doc_id, p.i, p.para, CASE WHEN f.size + {add} > {limit} THEN {add} ELSE f.size + {add} END,
             f.grp + CASE WHEN f.size + {add} > {limit} THEN 1 ELSE 0 END
      FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)"""


CHUNKS_SQL = f"""{fold_sql(CHUNK, 0)},
g AS (SELECT doc_id, grp, trim(string_agg(para, {NL} ORDER BY i), {BLANKS}) AS text FROM f GROUP BY doc_id, grp),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS chunk_index, text,
                  CAST(length(text) AS INTEGER) AS length FROM g WHERE text <> '')"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the pages of one book."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), number.alias("page"), "text")


PAGES_SQL = "pages_ AS (SELECT source AS doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page, text FROM documents)"


def single_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a document of one page."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text", "lang")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments of each document's lines: the first quarter, and a quarter from the middle on."""
    n = F.size(lines(F.col("text")))
    quarter, half = F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int")
    pair = F.array(F.struct(F.lit(0).alias("chunk"), F.lit(1).alias("first"), quarter.alias("last")), F.struct(F.lit(1).alias("chunk"), half.alias("first"), (half + quarter).alias("last")))
    rows = single_pages(spark, sf_dir).select("doc_id", "page", F.inline(pair))
    return rows.where("first >= 1 and first <= last")


SEGMENTS_SQL = f"""l AS (SELECT doc_id, string_split(text, {NL}) AS ls, len(string_split(text, {NL})) AS n FROM documents),
seg AS (SELECT doc_id, 0 AS chunk, 1 AS first, n // 4 AS last FROM l UNION ALL SELECT doc_id, 1, n // 2, n // 2 + n // 4 FROM l),
segs AS (SELECT * FROM seg WHERE first >= 1 AND first <= last),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
miss AS (SELECT doc_id, i AS line FROM ln WHERE trim(line, {BLANKS}) <> ''
         AND NOT EXISTS (SELECT 1 FROM segs WHERE segs.doc_id = ln.doc_id AND ln.i BETWEEN first AND last))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalog rows: groups are source and language, enabled is the label's quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, 0)")
    return rows.select(F.col("doc_id").cast("string").alias("file_md5"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_name"), F.concat_ws("|", "source", "lang").alias("groups"), F.lit("").alias("tags"), F.octet_length("text").cast("long").alias("file_size"), (F.floor(F.col("n_chars") / CHUNK) + 1).cast("long").alias("total_chunks"), at.alias("indexed_at"), (F.coalesce("quality", F.lit(1)) == 1).alias("is_enabled"))


FILES_SQL = f"""files AS (SELECT CAST(d.doc_id AS VARCHAR) AS file_md5, 'doc_' || d.doc_id AS file_name, source || '|' || lang AS groups, '' AS tags,
  CAST(strlen(text) AS BIGINT) AS file_size, n_chars // {CHUNK} + 1 AS total_chunks,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS BIGINT)) AS indexed_at, coalesce(quality, 1) = 1 AS is_enabled
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("op_type"), F.col("props").alias("op_detail"), F.col("user_id").cast("string").alias("file_md5"), F.col("ts").alias("op_time"))


AUDIT_SQL = "audit AS (SELECT event_id AS id, event_type AS op_type, props AS op_detail, CAST(user_id AS VARCHAR) AS file_md5, ts AS op_time FROM events)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)")
    source = F.struct(F.col("role").alias("doc_name"), F.array(F.col("turn").cast("int")).alias("page_nums"), F.col("turn").cast("int").alias("chunk_index"), F.lit("").alias("chapter_title"), F.lit("").alias("chapter_index"), F.when(F.col("turn") % 2 == 0, F.lit(7)).alias("llm_score"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_no"), F.col("text").alias("query"), F.col("role").alias("answer"), F.when(F.col("turn") % 3 == 0, F.array().cast(f"array<{SOURCE}>")).otherwise(F.array(source)).alias("sources"), F.length("text").cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), (F.col("turn") * 100).alias("elapsed_ms"), at.alias("created_at"))


TURNS_SQL = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn_no, text AS query, role AS answer,
  CAST(length(text) AS BIGINT) AS input_tokens, 1 AS output_tokens, turn * 100 AS elapsed_ms,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)) AS created_at FROM conversations)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
