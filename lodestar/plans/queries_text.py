"""Queries of chunking, pages, assembly, tables and correction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import bytes_display, chars_display, document_name, file_size_display, keywords, lines
from lodestar.operators import assembly, chunking, correction, pages, tables
from lodestar.plans import inputs
from lodestar.plans.inputs import BLANKS, NL, CHUNKS_SQL, PAGES_SQL, SEGMENTS_SQL, fold_sql, table
from lodestar.plans.registry import query
from lodestar.sources import files as sources


@query("chunk_paragraph", f"""WITH RECURSIVE {CHUNKS_SQL}
SELECT doc_id, chunk_index, text, CAST(doc_id AS VARCHAR) || '_chunk_' || chunk_index AS chunk_id, length FROM chunks""")
def chunk_paragraph(spark, sf_dir):
    return inputs.chunks(spark, sf_dir)


@query("chunk_oversize_split", f"""WITH RECURSIVE {fold_sql(1000, 1, "length(text) > 1000")},
g AS (SELECT doc_id, grp, string_agg(para, {NL} ORDER BY i) AS text FROM f GROUP BY doc_id, grp
      UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 1000)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS chunk_index, text, CAST(length(text) AS INTEGER) AS length FROM g""")
def chunk_oversize_split(spark, sf_dir):
    parts = chunking.split_oversize(F.col("text"), F.lit("text"), 1000, "\n")
    return chunking.numbered(table(spark, sf_dir, "documents").select("doc_id", parts.alias("p")), "p").drop("chunk_id")


def _books(spark, sf_dir):
    """Each conversation as a text of chapters, one a turn, with titles of one of three kinds or, of every fourth, none."""
    n = (F.col("turn") + 1).cast("string")
    kinds = F.col("conv_id") % 4
    head = F.when(kinds == 0, F.concat(F.lit("第"), n, F.lit("章 begin\n"))).when(kinds == 1, F.concat(n, F.lit(". Part\n"))).when(kinds == 2, F.concat(F.lit("Chapter "), n, F.lit("\n"))).otherwise(F.lit(""))
    piece = F.struct("turn", F.concat(head, F.col("text")).alias("t"))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(piece)).alias("p")).select("doc_id", F.array_join(F.col("p.t"), "\n").alias("text"))


_HEAD = f"CASE conv_id % 4 WHEN 0 THEN '第' || (turn + 1) || '章 begin' || {NL} WHEN 1 THEN (turn + 1) || '. Part' || {NL} WHEN 2 THEN 'Chapter ' || (turn + 1) || {NL} ELSE '' END"
_BOOKS = f"books AS (SELECT conv_id AS doc_id, string_agg({_HEAD} || text, {NL} ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
_RULES = [r".{0,20}第[两〇零千百十九八七六五四三二一０-９\d]+[篇部卷节回章].{0,30}", r"\s{0,8}\d{1,4}[.．、\s]\s*\S.{0,28}", r"\s{0,8}[cC]hapter\s+\d+.{0,40}"]
_COUNTS = f"""counted AS (SELECT doc_id, text, greatest(1, least(length(text), 100000) // 6000) AS need, {", ".join(f"len(regexp_extract_all(left(text, 100000), '(?m)^{r}$')) AS n{i}" for i, r in enumerate(_RULES, 1))} FROM books)"""
_RULE = "CASE WHEN n1 >= need THEN 1 WHEN n2 >= need THEN 2 WHEN n3 >= need THEN 3 END"


@query("chapter_density", f"""WITH {_BOOKS}, {_COUNTS}
SELECT doc_id, CAST(n1 AS INTEGER) AS n1, CAST(n2 AS INTEGER) AS n2, CAST(n3 AS INTEGER) AS n3, CAST(need AS INTEGER) AS need,
       {_RULE} AS rule FROM counted""")
def chapter_density(spark, sf_dir):
    text = F.col("text")
    counts = chunking.rule_counts(text)
    return _books(spark, sf_dir).select("doc_id", *[counts[i].alias(f"n{i + 1}") for i in range(3)], chunking.required_titles(text, 6000).alias("need"), chunking.chapter_rule(text).alias("rule"))


@query("chunk_chapters", f"""WITH RECURSIVE {_BOOKS}, {_COUNTS},
ruled AS (SELECT doc_id, text, {_RULE} AS rule FROM counted),
ln AS (SELECT doc_id, rule, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS i FROM ruled WHERE rule IS NOT NULL),
marked AS (SELECT *, sum(CASE WHEN {" OR ".join(f"rule = {i} AND regexp_full_match(line, '{r}')" for i, r in enumerate(_RULES, 1))} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS ch FROM ln),
chap AS (SELECT doc_id, ch, trim(arg_min(line, i), {BLANKS}) AS title, trim(string_agg(line, {NL} ORDER BY i), {BLANKS}) AS text FROM marked WHERE ch > 0 GROUP BY doc_id, ch)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ch) - 1 AS INTEGER) AS chunk_index,
       CAST(doc_id AS VARCHAR) || '_chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY ch) - 1) AS chunk_id, title AS chapter_title,
       ch || '/' || max(ch) OVER (PARTITION BY doc_id) AS chapter_index, text, CAST(length(text) AS INTEGER) AS length FROM chap
UNION ALL SELECT doc_id, 0, CAST(doc_id AS VARCHAR) || '_chunk_0', NULL, NULL, trim(text, {BLANKS}), CAST(length(trim(text, {BLANKS})) AS INTEGER) FROM ruled WHERE rule IS NULL AND trim(text, {BLANKS}) <> ''""")
def chunk_chapters(spark, sf_dir):
    """All three kinds of titles, and books without any. Texts over the soft limit are one paragraph here (there is no blank line), so each stays one chunk."""
    return chunking.chunk_texts(_books(spark, sf_dir))


@query("dedupe_md5", "SELECT file_md5, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT md5(text) AS file_md5, doc_id FROM documents WHERE text IS NOT NULL) WHERE file_md5 NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 7 = 3) GROUP BY file_md5")
def dedupe_md5(spark, sf_dir):
    """Texts as files, of which the catalog has some already: what is left to take in, with the number of files of one content."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    files = docs.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.octet_length("text").cast("long").alias("length"), "doc_id")
    found = sources.catalogued(files)
    counts = found.join(docs.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id"), "path").groupBy("file_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    known = sources.catalogued(files.where("doc_id % 7 = 3"))
    return sources.unseen(found, known).select("file_md5").join(counts, "file_md5").select("file_md5", "doc_id", "copies")


@query("file_validate", """WITH f AS (SELECT doc_id, 'dir/' || source || '_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' ELSE '.TXT' END AS path, text FROM documents)
SELECT doc_id, regexp_replace(split_part(path, '/', 2), '(?i)\\.pdf$', '') AS doc_name,
  CASE WHEN doc_id % 4 = 2 THEN 'bad_type' WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 209715200 THEN 'too_large' WHEN doc_id % 4 = 1 AND NOT starts_with(text, '%PDF-') THEN 'bad_header' END AS problem FROM f""")
def file_validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".pdf", ".docx", ".TXT"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("dir/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), ending)
    head = F.substring(F.encode("text", "UTF-8"), 1, 5)
    return docs.select("doc_id", document_name(path).alias("doc_name"), sources.problem(path, F.octet_length("text"), head).alias("problem"))


_TYPE = f"CASE WHEN trim(text, {BLANKS}) = '' THEN '空白页' WHEN len(list_filter(string_split(text, {NL}), lambda x: starts_with(ltrim(x), '|'))) >= 2 THEN '含表格' ELSE '纯文本' END"


@query("page_type", f"SELECT doc_id, {_TYPE} AS page_type FROM documents")
def page_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.page_type(F.col("text")).alias("page_type"))


@query("page_batch_format", f"""WITH {PAGES_SQL}, t AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS total, text, {_TYPE} AS kind FROM pages_),
s AS (SELECT doc_id, page, '[第' || page || '页，共' || total || '页]  [' || kind || ']' || {NL} || CASE WHEN kind = '空白页' THEN '（本页为空）'
  ELSE array_to_string(list_transform(string_split(text, {NL}), lambda x, i: 'L' || i || ': ' || x), {NL}) END AS text FROM t)
SELECT doc_id, CAST((page - 1) // 3 AS INTEGER) AS batch, min(page) AS first_page, max(page) AS last_page, string_agg(text, {NL} || {NL} ORDER BY page) AS text FROM s GROUP BY doc_id, (page - 1) // 3""")
def page_batch_format(spark, sf_dir):
    return pages.batches(inputs.pages(spark, sf_dir))


_TERMS = ("License", "the", "and", "que", "und", "der", "les", "por")


@query("keyword_tags", f"SELECT doc_id, array_to_string(list_filter({list(_TERMS)!r}, lambda k: contains(text, k)), ',') AS tags FROM documents")
def keyword_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(keywords(F.col("text"), _TERMS), ",").alias("tags"))


def _missing(spark, sf_dir):
    return assembly.missing_lines(inputs.single_pages(spark, sf_dir), inputs.segments(spark, sf_dir))


@query("coverage_missing", f"WITH {SEGMENTS_SQL} SELECT doc_id, 1 AS page, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS missing FROM miss GROUP BY doc_id")
def coverage_missing(spark, sf_dir):
    return _missing(spark, sf_dir).select("doc_id", "page", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


_ISLANDS = f"""{SEGMENTS_SQL}, isl AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM miss),
rng AS (SELECT doc_id, CAST(min(line) AS INTEGER) AS first, CAST(max(line) AS INTEGER) AS last FROM isl GROUP BY doc_id, k)"""


@query("missing_ranges", f"""WITH {_ISLANDS} SELECT doc_id, 1 AS page, '- 第1页: ' || string_agg(CASE WHEN first = last THEN 'L' || first ELSE 'L' || first || '-L' || last END, ', ' ORDER BY first) AS text FROM rng GROUP BY doc_id""")
def missing_ranges(spark, sf_dir):
    return assembly.range_text(assembly.missing_ranges(_missing(spark, sf_dir)))


@query("missing_totals", f"WITH {SEGMENTS_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS missing FROM miss GROUP BY doc_id")
def missing_totals(spark, sf_dir):
    return _missing(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.size("missing")).alias("missing"))


@query("orphan_asof", f"""WITH {SEGMENTS_SQL}
SELECT m.doc_id, 1 AS page, CAST(m.line AS INTEGER) AS line,
  CAST((SELECT arg_max(chunk, last) FROM segs s WHERE s.doc_id = m.doc_id AND s.last < m.line) AS BIGINT) AS before,
  CAST((SELECT arg_min(chunk, first) FROM segs s WHERE s.doc_id = m.doc_id AND s.first > m.line) AS BIGINT) AS after FROM miss m""")
def orphan_asof(spark, sf_dir):
    return assembly.orphans(_missing(spark, sf_dir), inputs.segments(spark, sf_dir))


def _headed(spark, sf_dir):
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## Part "), F.col("turn").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.concat(head, F.col("text")).alias("text"))


_MAP = r"""h AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, CASE WHEN turn % 3 = 0 THEN '## Part ' || turn || chr(10) ELSE '' END || text AS text FROM conversations),
hd AS (SELECT doc_id, page, trim(regexp_extract(left(text, 200), '#{1,3}\s+(.+)', 1)) AS title, regexp_matches(left(text, 200), '#{1,3}\s+(.+)') AS found, max(page) OVER (PARTITION BY doc_id) AS last FROM h WHERE trim(text) <> ''),
cm AS (SELECT doc_id, page AS start, coalesce(lead(page - 1) OVER (PARTITION BY doc_id ORDER BY page), last) AS "end", CASE WHEN title = '' THEN '未命名' ELSE title END AS title FROM hd WHERE found)"""


@query("chapter_map", f'WITH {_MAP} SELECT doc_id, start, CAST("end" AS INTEGER) AS "end", title FROM cm')
def chapter_map(spark, sf_dir):
    return pages.chapter_map(_headed(spark, sf_dir))


@query("chapter_map_overlap", f"""WITH {_MAP}, b AS (SELECT doc_id, CAST((page - 1) // 3 AS INTEGER) AS batch, min(page) AS f, max(page) AS l FROM h GROUP BY ALL)
SELECT doc_id, batch, start, CAST("end" AS INTEGER) AS "end", title FROM b JOIN cm USING (doc_id) WHERE start <= l AND "end" >= f""")
def chapter_map_overlap(spark, sf_dir):
    rows = _headed(spark, sf_dir)
    ranges = rows.groupBy("doc_id", F.floor((F.col("page") - 1) / 3).cast("int").alias("batch")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return pages.chapters_of_batches(ranges, pages.chapter_map(rows))


@query("assemble_segments", f"""WITH {SEGMENTS_SQL},
part AS (SELECT s.doc_id, s.chunk, array_to_string(list_slice(ls, first, least(last, n)), {NL}) AS part FROM segs s JOIN l USING (doc_id)),
body AS (SELECT doc_id, string_agg(part, {NL} ORDER BY chunk) AS data FROM part GROUP BY doc_id)
SELECT doc_id, 0 AS ord, 'text' AS type, CASE WHEN doc_id % 2 = 0 THEN '[概述] ' || lang || {NL} ELSE '' END || CASE WHEN doc_id % 3 = 0 AND ls[1] <> '' THEN '[表头]' || {NL} || ls[1] || {NL} ELSE '' END || data AS text,
  '1' AS page_nums, array_to_string(list_filter({list(_TERMS)!r}, lambda k: contains(data, k)), ',') AS keywords
FROM body JOIN l USING (doc_id) JOIN documents USING (doc_id) WHERE trim(data, {BLANKS}) <> ''""")
def assemble_segments(spark, sf_dir):
    segs = inputs.segments(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "page", F.array("first", "last").alias("line_range")))).alias("s"))
    listed = F.transform("s", lambda x: F.struct(x["page"].alias("page"), x["line_range"].alias("line_range")))
    docs = inputs.single_pages(spark, sf_dir)
    header = F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit(1).alias("page"), F.array(F.lit(1)).alias("lines")))
    defs = segs.join(docs, "doc_id").select("doc_id", F.lit(0).alias("ord"), F.lit("text").alias("chunk_type"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("context_summary"), header.alias("header_source"), listed.alias("segments"))
    out = assembly.assemble(defs, docs.select("doc_id", "page", "text"), _TERMS)
    return out.select("doc_id", "ord", "type", "text", F.array_join(F.col("page_nums").cast("array<string>"), ",").alias("page_nums"), F.array_join("keywords", ",").alias("keywords"))


@query("line_previews", f"""WITH RECURSIVE {CHUNKS_SQL},
s AS (SELECT doc_id, chunk_index, array_to_string(list_slice(string_split(text, {NL}), 1, 3), {NL}) AS t FROM chunks)
SELECT doc_id, chunk_index, CASE WHEN length(t) > 150 THEN left(t, 150) || '...' ELSE t END AS preview FROM s""")
def line_previews(spark, sf_dir):
    return inputs.chunks(spark, sf_dir).select("doc_id", "chunk_index", sources.preview(F.col("text")).alias("preview"))


@query("text_layer", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, {NL}), lambda x: trim(x, {BLANKS})), lambda x: x <> ''), {NL}) AS text FROM documents")
def text_layer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sources.text_layer(F.col("text")).alias("text"))


@query("pages_to_do", f"WITH {PAGES_SQL} SELECT doc_id, page FROM pages_ WHERE length(text) <= 1000")
def pages_to_do(spark, sf_dir):
    """Pages of over 1000 characters have been done."""
    every = inputs.pages(spark, sf_dir)
    return sources.pages_to_do(every.select("doc_id", "page"), every.where("length(text) > 1000").select("doc_id", "page"))


@query("table_cluster")
def table_cluster(spark, sf_dir):
    """Line items as words on pages: supplier and line number make the page, order and part the place."""
    rows = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 4 * 150 + F.col("l_orderkey") % 5).cast("int"), (F.col("l_orderkey") % 40 * 20 + F.col("l_partkey") % 3).cast("int")
    order = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity"))
    words = rows.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), order.alias("word_no"), F.concat_ws("", "l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("value"), F.lit(90).alias("confidence"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 12).alias("y2"))
    return tables.tables(words).select("doc_id", "page", tables.markdown(F.col("cells")).alias("markdown"))


_CELLS = "[[CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, p_brand], [p_type, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END], [CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'a|b' END, '']]"


def _cells(spark, sf_dir):
    blank = lambda n, value, c: F.when(F.col("p_partkey") % n == 0, F.lit(value)).otherwise(c)
    rows = F.array(F.array(blank(3, "", F.col("p_name")), F.col("p_brand")), F.array(F.col("p_type"), blank(5, " ", F.col("p_size").cast("string"))), F.array(blank(2, "", F.lit("a|b")), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", rows.alias("cells"))


@query("table_markdown", f"""WITH c AS (SELECT p_partkey, {_CELLS} AS cells FROM part)
SELECT p_partkey, array_to_string(list_transform(cells, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', '\\|')), ' | ') || ' |'), chr(10)) AS markdown FROM c""")
def table_markdown(spark, sf_dir):
    return _cells(spark, sf_dir).select("p_partkey", tables.markdown(F.col("cells")).alias("markdown"))


@query("header_rows", f"""WITH c AS (SELECT p_partkey, {_CELLS} AS cells FROM part)
SELECT p_partkey, 0 AS header_row, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS n_header FROM c""")
def header_rows(spark, sf_dir):
    return _cells(spark, sf_dir).select("p_partkey", tables.header_row(F.col("cells"))["row"].alias("header_row"), tables.header_rows(F.col("cells")).alias("n_header"))


@query("merged_cells", "SELECT p_partkey, 0 AS col, p_type AS content, true AS merged_from_above FROM part WHERE p_partkey % 3 = 0")
def merged_cells(spark, sf_dir):
    found = _cells(spark, sf_dir).select("p_partkey", F.explode(tables.merged_cells(F.col("cells"), F.lit(0))).alias("col", "v"))
    return found.select("p_partkey", "col", "v.content", "v.merged_from_above")


@query("row_blocks", """WITH r AS (SELECT l_suppkey AS page_id, l_orderkey % 1000 AS row FROM lineitem GROUP BY ALL),
g AS (SELECT page_id, row, CASE WHEN row - lag(row) OVER (PARTITION BY page_id ORDER BY row) > 20 THEN 1 ELSE 0 END AS new FROM r),
b AS (SELECT page_id, row, sum(new) OVER (PARTITION BY page_id ORDER BY row) AS block FROM g)
SELECT page_id, min(row) AS first, max(row) AS last FROM b GROUP BY page_id, block""")
def row_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page_id"), (F.col("l_orderkey") % 1000).alias("row")).distinct()
    return tables.row_blocks(rows.withColumn("height", F.lit(200)))


@query("entity_normalize", r"SELECT c_custkey, lower(trim(regexp_replace(regexp_replace(c_name || ', L.P.  #' || c_mktsegment, '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))) AS normal FROM customer")
def entity_normalize(spark, sf_dir):
    name = F.concat(F.col("c_name"), F.lit(", L.P.  #"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", correction.normalize_column(name).alias("normal"))


_EDITED = "CASE n % 5 WHEN 0 THEN {n} WHEN 1 THEN replace({n}, '0', 'O') WHEN 2 THEN left({n}, length({n}) - 1) WHEN 3 THEN {n} || '.' || left({n}, 2) ELSE left({n}, 4) || 'x' || substr({n}, 5) END"


@query("entity_fuzzy", rf"""WITH lex AS (SELECT n_name || ' Holdings ' || r_name AS entity FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey AS id, c_custkey AS n, n_name || ' Holdings ' || r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT id, lower(trim(regexp_replace(regexp_replace({_EDITED.format(n="name")}, '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))) AS a FROM c), b AS (SELECT entity, lower(entity) AS b FROM lex)
SELECT id, entity, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM a, b WHERE levenshtein(a, b) <= 2""")
def entity_fuzzy(spark, sf_dir):
    """Customers' names, made of a nation and its region, most of them with edits, against all such names."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("n_name", F.lit(" Holdings "), "r_name").alias("name"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("n"), "name")
    return correction.near_entities(rows.select("id", F.expr(_EDITED.format(n="name")).alias("name")), places.select(F.col("name").alias("entity")))


_LEXICON = ", ".join(f"('{w}')" for w in sorted(correction.LEXICON))
_PAIRS = sorted({a + b for p in correction.CONFUSED for a in p for b in p if a != b})


@query("word_fix", f"""WITH lex(term) AS (VALUES {_LEXICON}), pair(a, b) AS (VALUES {", ".join(f"('{p[0]}', '{p[1]}')" for p in _PAIRS)}),
w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM documents
      UNION SELECT regexp_replace(term, 'i', 'l') FROM lex UNION SELECT regexp_replace(term, 'c', 'e') FROM lex UNION SELECT regexp_replace(term, 't', 'r') FROM lex),
spot AS (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM lex),
made AS (SELECT left(term, i - 1) || b || substr(term, i + 1) AS word, min(term) AS term FROM spot JOIN pair ON term[i] = a GROUP BY 1),
hit AS (SELECT * FROM made ANTI JOIN lex ON word = lex.term)
SELECT word, coalesce(term, word) AS fixed FROM w LEFT JOIN hit USING (word) WHERE word <> ''""")
def word_fix(spark, sf_dir):
    from lodestar.operators.retrieval import tokens

    seen = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word"))
    made = spark.createDataFrame([(w.replace(a, b, 1),) for w in sorted(correction.LEXICON) for a, b in ("il", "ce", "tr")], "word string")
    return correction.fixed_words(seen.unionByName(made).distinct())


@query("correct_text")
def correct_text(spark, sf_dir):
    out = correction.corrected(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "corrected.text", "corrected.corrections", "corrected.entity_corrections")


@query("size_format", """SELECT doc_id, CASE WHEN n >= 10000 THEN printf('%d.%d 万字符', t // 10, t % 10) ELSE format('{:,}', n) || ' 字符' END AS chars,
  CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE b || ' B' END AS bytes,
  CASE WHEN b < 1048576 THEN printf('%.1fKB', b / 1024.0) ELSE printf('%.1fMB', b / 1048576.0) END AS short
FROM (SELECT doc_id, n_chars AS n, n_chars * 37 AS b, n_chars // 1000 + CASE WHEN n_chars % 1000 > 500 OR (n_chars % 1000 = 500 AND (n_chars // 1000) % 2 = 1) THEN 1 ELSE 0 END AS t FROM documents)""")
def size_format(spark, sf_dir):
    n, b = F.col("n_chars"), F.col("n_chars") * 37
    return table(spark, sf_dir, "documents").select("doc_id", chars_display(n).alias("chars"), bytes_display(b).alias("bytes"), file_size_display(b).alias("short"))


@query("page_confidence", "SELECT l_suppkey AS doc_id, round(coalesce(avg(l_quantity) FILTER (WHERE l_quantity >= 30), 0.0), 6) AS avg_confidence FROM lineitem GROUP BY l_suppkey")
def page_confidence(spark, sf_dir):
    """The mean of confidences over the least one of a page's words."""
    pages_ = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.collect_list("l_quantity").alias("scores"))
    return pages_.select("doc_id", F.round(tables.mean_confidence(F.filter("scores", lambda x: x >= 30)), 6).alias("avg_confidence"))
