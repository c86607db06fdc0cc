"""The engine's front: indexing a folder, searching with its pauses, documents, groups, audit and sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.config import OPTIONS, Choice, Config
from lodestar.operators import catalog, chunking, context, gaps, history, rerank, retrieval
from lodestar.plans import paged
from lodestar.sources import files as sources
from lodestar.sources import providers
from lodestar.sources.store import Scratch, Table

NO_READER = "no reader for PDF: give Documents a reader"


@dataclass
class Pending:
    """A search that waits for a choice; a value of its session, not of the engine."""

    kind: str
    query: str
    candidates: DataFrame | None = None
    tokens: tuple[int, int] = (0, 0)
    past: str = ""


@dataclass
class Result:
    status: str
    query: str
    answer: str | None = None
    sources: list[dict] = field(default_factory=list)
    pending: Pending | None = None
    top_score: int | None = None
    error: str | None = None
    tokens: tuple[int, int] = (0, 0)

    @property
    def options(self) -> tuple[Choice, ...]:
        return OPTIONS[self.pending.kind] if self.pending else ()


class Documents:
    """Catalog, chunks, pages, full-text index and audit log.

    reader: gives the pages of a PDF; without one a PDF is reported as not read. page_model and fix_model cut pages into chunks
    and place lines that were missed; regex_model is asked for chapter titles where no rule fits; progress is told each step."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), embedder: Callable[[], providers.Embedder] | None = None, clock: Callable[[], datetime] = datetime.now, reader: Callable[[], providers.Ocr] | None = None, page_model: Callable[[], providers.PageModel] = providers.WholePages, fix_model: Callable[[], providers.FixModel] = providers.StandAlone, regex_model: Callable[[], providers.RegexModel] | None = None, progress: providers.Progress | None = None) -> None:
        self.spark, self.config, self.clock, self.root = spark, config, clock, root
        dim = config.embedding_dim
        self.embedder = embedder or (lambda: providers.HashedWords(dim))
        self.reader, self.page_model, self.fix_model, self.regex_model = reader, page_model, fix_model, regex_model
        self.progress = progress or providers.Progress()
        self.files = Table(spark, f"{root}/files", schemas.FILES)
        self.chunks = Table(spark, f"{root}/chunks", schemas.CHUNKS)
        self.pages = Table(spark, f"{root}/pages", schemas.PAGE_RESULT)
        self.postings = Table(spark, f"{root}/postings", schemas.POSTINGS, "bucket")
        self.lengths = Table(spark, f"{root}/lengths", schemas.LENGTHS)
        self.audit = Table(spark, f"{root}/audit", schemas.AUDIT)

    def _log(self, rows: DataFrame) -> None:
        self.audit.write(catalog.append_audit(self.audit.read(), rows, self.config.audit_rows))

    @contextmanager
    def _step(self, text: str) -> Iterator[None]:
        self.progress.start(text)
        yield
        self.progress.end(text)

    def index(self, path: str, separator: str = "\n\n") -> DataFrame:
        """Takes in the files of a folder that the catalog hasn't: doc_id, doc_name, num_chunks, success, skipped, error, of each file of the folder.

        Contents are read once. The full-text index and the chunks are written first and the catalog after them, each only what
        it hasn't yet, so what is in the catalog has all of it; a run that stops between is put right by the next."""
        work = Scratch(self.spark, self.root)
        pdf = F.lower("file_name").endswith(".pdf")
        with self._step("files"):
            raw = sources.catalogued(sources.read_binary(self.spark, path, empty=True), self.config)
            body = sources.decode(F.when(F.col("problem").isNull() & ~pdf, F.col("content")))
            found = work.keep("found", raw.withColumn("text", body).drop("content"))
            old = self.files.read()
            new = sources.unseen(found.where("problem is null"), old)
        if self.reader is None:
            found = found.withColumn("problem", F.when(F.col("problem").isNull() & pdf, F.lit(NO_READER)).otherwise(F.col("problem")))
        had = self.chunks.read().select("doc_id").distinct()
        with self._step("chunks"):
            made = self._text_chunks(new.where(~pdf).select(F.col("file_md5").alias("doc_id"), "text"), separator)
            papers = new.where(pdf).select(F.col("file_md5").alias("doc_id"), "path")
            if self.reader is not None and papers.limit(1).count():
                made = made.unionByName(self._page_chunks(work, path, papers))
            made = work.keep("made", made.join(new.select(F.col("file_md5").alias("doc_id"), "doc_name"), "doc_id"))
        with self._step("index"):
            before = work.keep("before", made.select("doc_id").distinct().join(had, "doc_id", "left_semi"))
            self.postings.append(retrieval.kept_postings(made.join(self.postings.read().select("doc_id").distinct(), "doc_id", "left_anti")))
            self.lengths.append(retrieval.kept_lengths(made.join(self.lengths.read().select("doc_id"), "doc_id", "left_anti")))
            self.chunks.append(providers.embedded(made.join(had, "doc_id", "left_anti"), self.embedder, config=self.config))
        with self._step("catalog"):
            counts = made.groupBy(F.col("doc_id").alias("file_md5")).agg(F.count("*").alias("total_chunks"))
            now = F.lit(self.clock()).cast("timestamp_ntz")
            rows = new.join(counts, "file_md5").select("file_md5", "file_name", F.col("path").alias("file_path"), "file_size", F.lit("").alias("file_type"), F.lit(catalog.DEFAULT_GROUP).alias("groups"), now.alias("indexed_at"), F.lit("ready").alias("status"), F.lit("").alias("tags"), "total_chunks", F.lit(True).alias("is_enabled"))
            rows = work.keep("rows", rows.join(before.select(F.col("doc_id").alias("file_md5"), F.lit(True).alias("there")), "file_md5", "left"))
            known = old.select("file_md5", F.lit(True).alias("known"), F.col("total_chunks").alias("n"))
            report = found.dropDuplicates(["file_md5"]).join(known, "file_md5", "left").join(counts, "file_md5", "left").withColumn("n", F.coalesce("n", "total_chunks"))
            error = F.when(F.col("known").isNull(), F.coalesce("problem", F.when(F.col("n").isNull(), F.lit("no text"))))
            out = report.select(F.col("file_md5").alias("doc_id"), "doc_name", F.coalesce("n", F.lit(0)).cast("int").alias("num_chunks"), F.col("n").isNotNull().alias("success"), F.coalesce("known", F.lit(False)).alias("skipped"), error.alias("error"))
            result = Scratch(self.spark, f"{self.root}/reports").keep("report", out)
            # what another run had begun is skipped work, and logged as such
            detail, state = F.when(F.col("there"), F.lit("跳过索引 (MD5 重复)")).otherwise(F.lit("新建索引")), F.when(F.col("there"), F.lit("skipped")).otherwise(F.lit("success"))
            self._log(catalog.audit_rows("index", detail, rows, state, now=self.clock()))
            self.files.append(rows)
        work.close()
        return result

    def _text_chunks(self, texts: DataFrame, separator: str) -> DataFrame:
        made = chunking.chunk_texts(texts, self.config, separator, self.regex_model)
        return made.select(F.col("chunk_id").alias("id"), "text", F.lit("text").alias("type"), "doc_id", F.array().cast("array<int>").alias("page_nums"), "chunk_index", "length", F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), F.coalesce("chapter_index", F.lit("")).alias("chapter_index"), F.array().cast("array<string>").alias("keywords"))

    def _page_chunks(self, work: Scratch, path: str, papers: DataFrame) -> DataFrame:
        """Chunks of PDFs (doc_id, path). Pages that an earlier run has read are taken from the pages table."""
        have = self.pages.read()
        to_do = papers.join(have.select("doc_id").distinct(), "doc_id", "left_anti")
        content = sources.read_binary(self.spark, path).select("path", "content").join(to_do, "path")
        read = work.keep("read", paged.read_pages(content, self.reader))
        self.pages.append(paged.page_results(read, self.config))
        rows = self.pages.read().join(papers.select("doc_id"), "doc_id", "left_semi").select("doc_id", "page", "text")
        made = paged.chunk_pages(self.spark, rows, work.root, self.page_model, self.fix_model, self.config)
        chunk_id = F.concat("doc_id", F.lit("_chunk_"), F.col("chunk_index").cast("string"))
        return made.select(chunk_id.alias("id"), "text", "type", "doc_id", "page_nums", "chunk_index", "length", F.lit("").alias("chapter_title"), F.lit("").alias("chapter_index"), "keywords")

    def page_totals(self) -> DataFrame:
        return paged.correction_totals(self.pages.read())

    def chunk(self, number: int) -> DataFrame:
        """The chunk of that number (from 1), in the order of documents and their chunks, of all that there are; no row if there are fewer."""
        ordered = self.chunks.read().drop("vector").orderBy("doc_id", "chunk_index")
        return ordered.offset(number - 1).limit(1) if number >= 1 else ordered.limit(0)

    def list(self) -> DataFrame:
        return catalog.grouped(self.files.read())

    def has(self, md5: str) -> bool:
        return bool(self.files.read().where(F.col("file_md5") == md5).limit(1).count())

    def any(self) -> bool:
        return bool(self.files.read().limit(1).count())

    def enabled(self) -> DataFrame:
        return self.files.read().where("is_enabled").select("file_md5")

    def set(self, name: str, md5: str, value: object) -> None:
        """Sets groups, tags, file_type or is_enabled of a file."""
        kind = "boolean" if name == "is_enabled" else "string"
        update = self.spark.createDataFrame([(md5, value)], f"file_md5 string, value {kind}")
        new, rows = catalog.set_field(self.files.read(), update, name)
        self._log(rows)
        self.files.write(new)

    def set_group(self, name: str, enabled: bool) -> None:
        new, rows = catalog.set_group_enabled(self.files.read(), name, enabled)
        self._log(rows)
        self.files.write(new)

    def delete(self, md5: str) -> int:
        """How many catalog rows went, 0 or 1; its chunks go too."""
        old = self.files.read()
        hit = old.where(F.col("file_md5") == md5)
        n = hit.count()
        if n:
            self._log(catalog.audit_rows("delete", F.col("file_name"), hit, now=self.clock()))
        self.files.write(catalog.delete(old, hit, "file_md5"))
        for table in (self.postings, self.lengths, self.chunks, self.pages):
            table.write(table.read().where(F.col("doc_id") != md5))
        return n

    def operations(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return catalog.audit_range(self.audit.read(), first, last, self.config.audit_page)

    def stats(self) -> DataFrame:
        return catalog.audit_stats(self.audit.read())

    def overview(self) -> DataFrame:
        return catalog.overview(self.files.read(), self.chunks.read(), self.config.embedding_dim, sources.folder_size(self.spark, f"{self.root}/files", f"{self.root}/chunks"))


class Search:
    """The funnel: hybrid search, pair scores, model scores and sieve, gaps, answer."""

    def __init__(self, docs: Documents, scorer: Callable[[], providers.ChunkScorer] = providers.WordOverlap, pair: Callable[[], providers.PairScorer] = providers.WordOverlap, answerer: Callable[[], providers.AnswerModel] = providers.FirstLines) -> None:
        self.docs, self.spark, self.config = docs, docs.spark, docs.config
        self.scorer, self.pair, self.answerer = scorer, pair, answerer
        self.turns = Table(docs.spark, f"{docs.root}/turns", schemas.TURNS)

    def search(self, query: str, past: str = "") -> Result:
        try:
            return self._search(query, past)
        except Exception as error:  # the caller shows it and keeps it as a turn
            return Result("error", query, error=str(error))

    def _search(self, query: str, past: str) -> Result:
        vector = self.docs.embedder().encode([query])[0].tolist()
        one = self.spark.createDataFrame([(0, query, vector)], "query_id long, text string, vector array<float>")
        enabled = self.docs.enabled().withColumnRenamed("file_md5", "doc_id") if self.docs.any() else None
        store = retrieval.allowed(self.docs.chunks.read(), self.docs.files.read())
        words = retrieval.bm25_kept(self.docs.postings.read(), self.docs.lengths.read(), one, enabled, config=self.config).withColumnRenamed("id", "doc_id")
        vectors = retrieval.nearest(store.select(F.col("id").alias("doc_id"), "vector"), one, config=self.config)
        held: list[DataFrame] = []
        try:
            found = retrieval.fuse(words, vectors, config=self.config).withColumnRenamed("doc_id", "id").persist()
            held.append(found)
            wanted = [r.id for r in found.select("id").collect()]  # hybrid_top_k of one query
            rows = found.join(F.broadcast(store.where(F.col("id").isin(wanted))), "id").select("query_id", "rank", "hybrid_score", *store.columns).withColumn("query", F.lit(query))
            scored = providers.pair_scored(rows, self.pair)
            best = rerank.rerank(scored, config=self.config).persist()
            if not best.limit(1).count():
                return Result("needs_user_choice", query, pending=Pending("zero_results", query, past=past))
            marks = providers.chunk_scores(best.withColumn("rank", F.col("ce_rank")), self.scorer, self.config).persist()
            used = marks.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))).first()
            aligned = rerank.align(best.withColumn("file", F.col("doc_id")).withColumn("doc_id", F.col("id")), marks.withColumnRenamed("chunk_id", "doc_id")).withColumn("doc_id", F.col("file")).drop("file").persist()
            top_score = aligned.agg(F.max("llm_score")).first()[0]
            kept = rerank.sieve(aligned, self.config)
            if not kept.limit(1).count():
                few = aligned.where(F.col("ce_rank") <= self.config.low_confidence_keep)
                return Result("needs_user_choice", query, pending=Pending("low_confidence", query, few, tuple(used), past), top_score=top_score, tokens=tuple(used))
            return self._answer(query, kept, past, tuple(used), top_score, False)
        finally:
            for df in held:
                df.unpersist()

    def _answer(self, query: str, chosen: DataFrame, past: str, used: tuple[int, int], top_score: int | None, unsure: bool) -> Result:
        named = [r.doc_id for r in chosen.select("doc_id").distinct().collect()]  # rerank_top_k at most
        store = self.docs.chunks.read().where(F.col("doc_id").isin(named))  # reaches the scan
        keys = gaps.fill(chosen.select("query_id", "doc_id", "chunk_index"), store.select("doc_id", "chunk_index", "length"), self.config)
        scores = chosen.select("doc_id", "chunk_index", "llm_score")
        full = keys.join(store.drop("vector"), ["doc_id", "chunk_index"]).join(scores, ["doc_id", "chunk_index"], "left")
        text = context.contexts(full, self.config).first()
        message = (past + "\n\n" if past else "") + f"文档片段：\n\n{text.context if text else ''}\n\n请回答以下问题：{query}"
        answer, i, o = self.answerer().answer(message)
        ref = context.source_ref(F.col("doc_name"), F.col("doc_id"), F.col("page_nums"), F.col("chunk_index"), F.col("chapter_title"), F.col("chapter_index"), F.col("llm_score"))
        refs = [r.asDict(True)["s"] for r in full.orderBy("doc_id", "chunk_index").select(ref.alias("s")).collect()]  # a few dozen rows at most
        return Result("success", query, (context.LOW_CONFIDENCE if unsure else "") + answer, refs, top_score=top_score, tokens=(used[0] + i, used[1] + o))

    def resume(self, pending: Pending | None, choice: Choice) -> Result:
        if pending is None:
            return Result("error", "", error="no search is pending")
        if choice == Choice.ABANDON:
            return Result("success", pending.query, "已取消本次查询。", tokens=pending.tokens)
        if choice == Choice.DIRECT_LLM:
            answer, i, o = self.answerer().answer((pending.past + "\n\n" if pending.past else "") + pending.query)
            return Result("success", pending.query, answer, tokens=(pending.tokens[0] + i, pending.tokens[1] + o))
        if pending.kind == "zero_results":
            return Result("error", pending.query, error="nothing was found to answer from")
        return self._answer(pending.query, pending.candidates, pending.past, pending.tokens, None, True)

    def save(self, result: Result, session_id: str | None = None, status: str | None = None, elapsed_ms: int = 0) -> str | None:
        """Keeps a finished search as a turn; of an unknown session a new one is made. What waits for a choice isn't kept."""
        if result.status == "needs_user_choice":
            return session_id
        turns = self.turns.read()
        if session_id is None or not turns.where(F.col("session_id") == session_id).limit(1).count():
            session_id = uuid.uuid4().hex
        row = (session_id, 0, result.query, result.answer or result.error, status or result.status, result.sources, *result.tokens, elapsed_ms, self.docs.clock())
        self.turns.append(history.next_turns(turns, self.spark.createDataFrame([row], schemas.TURNS)))
        return session_id

    def sessions(self, limit: int = 30) -> DataFrame:
        return history.session_list(history.sessions(self.turns.read()), limit)

    def session(self, session_id: str) -> DataFrame:
        return history.restore(self.turns.read(), session_id)

    def delete_session(self, session_id: str) -> bool:
        turns = self.turns.read()
        hit = turns.where(F.col("session_id") == session_id).limit(1).count() > 0
        if hit:
            self.turns.write(turns.where(F.col("session_id") != session_id))
        return hit
