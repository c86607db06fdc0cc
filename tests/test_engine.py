import json
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.config import Choice, Config
from lodestar.plans.facade import Documents, Pending, Search
from lodestar.sources import files, providers
from lodestar.sources.store import Table
from lodestar.streaming import ingest

CFG = Config(embedding_dim=32)


def write(folder: Path, **texts):
    folder.mkdir(exist_ok=True)
    for name, data in texts.items():
        (folder / name.replace("__", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_files(spark, tmp_path):
    folder = write(tmp_path / "in", a__txt="héllo\r\nx\ry", b__txt="中文".encode("gbk"), c__pdf=b"%PDF-1.4", d__pdf=b"no", e__docx="x", f__txt=b"", g__txt=b"\xff\xfe\x00")
    rows = {r.file_name: r for r in files.catalogued(files.read_binary(spark, folder, empty=True)).collect()}
    assert {n: r.problem for n, r in rows.items()} == {"a.txt": None, "b.txt": None, "c.pdf": None, "d.pdf": "bad_header", "e.docx": "bad_type", "f.txt": "empty", "g.txt": None}
    assert rows["c.pdf"].doc_name == "c" and rows["a.txt"].doc_name == "a.txt"
    got = {r.doc_name: r.text for r in files.texts(files.catalogued(files.read_binary(spark, folder))).collect()}
    assert got["a.txt"] == "héllo\nx\ny" and got["b.txt"] == "中文"
    assert files.folder_size(spark, folder) == sum(p.stat().st_size for p in Path(folder).iterdir()) and files.folder_size(spark, folder, folder + "/none") == -1


def test_page_cache(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, None), ("d", 10, "ten")], schemas.PAGES)
    files.write_cache(pages, str(tmp_path), "run1")
    files.write_cache(pages.limit(1), str(tmp_path), "run0")
    assert [(r.page, r.text) for r in files.cached_pages(spark, str(tmp_path)).orderBy("page").collect()] == [(1, "one"), (2, ""), (3, "ten")]
    assert [r.page for r in files.pages_to_do(pages, pages.where("page < 10")).collect()] == [10] and files.in_bounds([3, 0, 1, 9], 3) == [1, 3]


def test_table_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "a int")
    assert t.read().count() == 0 and not t.exists()
    t.append(spark.range(3).selectExpr("cast(id as int) a"))
    t.append(spark.range(1).selectExpr("cast(id as int) a"))
    t.write(t.read().where("a > 0"))
    t.vacuum()
    assert sorted(r.a for r in t.read().collect()) == [1, 2]


def engine(spark, tmp_path):
    folder = write(tmp_path / "in", one__txt="apple pie recipe\n\n" + "filler " * 600 + "\n\nmore apple", two__txt="banana bread", three__txt="banana bread")
    docs = Documents(spark, str(tmp_path / "store"), CFG, clock=lambda: datetime(2024, 1, 1))
    return docs, folder


def test_engine(spark, tmp_path):
    docs, folder = engine(spark, tmp_path)
    first = docs.index(folder).collect()
    assert sorted((r.num_chunks, r.success, r.skipped) for r in first) == [(1, True, False), (3, True, False)]
    assert all(r.skipped for r in docs.index(folder).collect())
    assert docs.any() and docs.overview().first().total_docs == 2 and docs.stats().first().total == 2
    search = Search(docs)
    got = search.search("banana bread")
    assert got.status == "success" and got.sources and got.tokens[0] > 0
    sid = search.save(got)
    assert search.save(got, sid) == sid and search.sessions().first().turn_count == 2
    assert len(search.session(sid).first().messages) == 2 and search.delete_session(sid) and not search.delete_session(sid)
    weak = search.search("banana xxxx yyyy zzzz")
    assert weak.pending.kind == "low_confidence" and weak.options == (Choice.RAG, Choice.DIRECT_LLM) and search.save(weak) is None
    assert search.resume(weak.pending, Choice.RAG).answer.startswith("（以下回答")
    docs.set_group("default", False)
    empty = search.search("banana")
    assert empty.pending.kind == "zero_results" and empty.options == (Choice.DIRECT_LLM, Choice.ABANDON)
    md5 = docs.files.read().first().file_md5
    docs.set("tags", md5, "new")
    assert docs.has(md5) and docs.delete(md5) == 1 and docs.delete(md5) == 0 and not docs.has(md5)
    assert docs.operations().count() == 2 + 2 + 1 + 1


def test_resume_states(spark, tmp_path):
    search = Search(Documents(spark, str(tmp_path / "s"), CFG))
    assert search.resume(None, Choice.RAG).status == "error"
    zero = Pending("zero_results", "q", tokens=(3, 4))
    assert search.resume(zero, Choice.RAG).status == "error"
    gone = search.resume(zero, Choice.ABANDON)
    assert (gone.status, gone.answer, gone.tokens) == ("success", "已取消本次查询。", (3, 4))
    assert search.resume(zero, Choice.DIRECT_LLM).sources == []


def test_stream(spark, tmp_path):
    folder = write(tmp_path / "in", one__txt="a\n\nb", two__txt="c")
    run = lambda: ingest.ingest(ingest.document_stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    run().awaitTermination()
    write(tmp_path / "in", three__txt="a\n\nb", four__txt="d")
    run().awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a\n\nb", "c", "d"]


def test_retry():
    calls, waits = [], []

    def fail(error):
        def call():
            calls.append(1)
            if len(calls) < 3:
                raise error
            return "ok"

        return call

    assert providers.with_retry(fail(providers.HttpError(503)), wait=waits.append) == "ok" and waits == [3.0, 6.0]
    calls.clear()
    with pytest.raises(providers.HttpError):
        providers.with_retry(fail(providers.HttpError(404)), wait=waits.append)
    calls.clear()
    assert providers.with_retry(fail(ConnectionError()), wait=waits.append) == "ok"


def test_answers():
    assert providers.json_answer('```json\n{"a": 1}\n```') == {"a": 1} and providers.json_answer("x") == {} and providers.json_answer("[1]") == {}
    good = json.dumps({"scores": [{"chunk_id": "a", "score": 3}, {"score": 1}]})
    assert providers.tool_scores([("submit_scores", good)]) == [{"chunk_id": "a", "score": 3}]
    assert providers.tool_scores([("other", good)]) == [] and providers.tool_scores([("submit_scores", good)] * 2) == [] and providers.tool_scores([("submit_scores", "{")]) == []


def test_scores_go_in_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    class Counting(providers.WordOverlap):
        def score(self, query, chunks):
            sizes.add(1)
            return super().score(query, chunks)

    df = spark.createDataFrame([(0, "a b", f"c{i}", "a", i) for i in range(12)], "query_id long, query string, id string, text string, rank int")
    assert providers.chunk_scores(df, Counting).count() == 12 and sizes.value == 2


def test_embedder(spark):
    v = providers.HashedWords(16).encode(["a b", "", "a b"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1]) and (v[0] == v[2]).all()
    got = providers.embedded(spark.createDataFrame([("a b",), (None,)], "text string"), lambda: providers.HashedWords(16)).collect()
    assert np.allclose(got[0].vector, v[0])


def test_progress():
    said, now = [], iter([0.0, 1.26])
    p = providers.Progress(lambda share, text: said.append(text), lambda: next(now))
    with pytest.raises(RuntimeError):
        p.end("x")
    p.start("begin")
    p.end("end")
    assert said == ["begin", "end (1.3s)"]
