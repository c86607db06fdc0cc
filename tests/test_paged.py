"""Documents of pages from the reader to the chunks, with scripted models."""

import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle

from lodestar.config import Config
from lodestar.plans import paged
from lodestar.plans.facade import NO_READER, Documents, Search
from lodestar.sources import providers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't have this folder
CFG = Config(embedding_dim=32, chapter_map_mode="rule_only")
PAGES = ["# Report 2020\nfirst line\nsecond line", "| a | b |\n| 1 | 2 |\ntotal assets", "", "third page here\nanother line\n\nlast line", "closing words"]


class Reader:
    """A PDF's pages are parted by form feeds; a page that begins with ! fails, and a file of !! can't be opened."""

    def pages(self, content):
        text = content.decode().removeprefix("%PDF-")
        if text.startswith("!!"):
            raise ValueError("broken file")
        return [{"page": i, "error": "no page"} if t.startswith("!") else {"page": i, "text": t, "avg_confidence": 90.0} for i, t in enumerate(text.split("\f"), 1)]


class Lazy(providers.WholePages):
    """Leaves out the last line of each page; told what it missed, it takes one more of them."""

    def reply(self, talk, forced):
        told = "上次遗漏的行" in talk[0]["content"]
        got = super().reply(talk, forced)
        for chunk in got["chunks"]:
            first, last = chunk["segments"][0]["line_range"]
            if not told and last > first:
                chunk["segments"][0]["line_range"] = [first, last - 1]
        return got


def test_tool_loop():
    chunks = [{"chunk_type": "text", "segments": [{"page": 1, "line_range": [1, 2]}]}]
    seen = []

    class Scripted:
        def __init__(self, *replies):
            self.replies = list(replies)

        def reply(self, talk, forced):
            seen.append((talk[-1]["content"], forced))
            return self.replies.pop(0)

    fetch = {"tool": "fetch_page", "page": 2}
    assert paged.tool_loop(Scripted(fetch, {"tool": "submit_chunks", "chunks": chunks}), "begin", ["a", "b\nc"]) == chunks
    assert seen == [("begin", False), ("[第2页]\nL1: b\nL2: c", False)]
    assert paged.tool_loop(Scripted({"text": "```json\n" + json.dumps({"chunks": chunks}) + "\n```"}), "begin", []) == chunks
    few = Config(fetch_page_limit=2)
    seen.clear()
    assert paged.tool_loop(Scripted(fetch, {"tool": "fetch_page", "page": 9}, {"tool": "submit_chunks", "chunks": []}), "x", ["a"], few) == []
    assert [f for _, f in seen] == [False, False, True] and "超出范围" in seen[-1][0]
    with pytest.raises(RuntimeError):
        paged.tool_loop(Scripted(fetch, fetch, fetch), "x", ["a"], few)
    with pytest.raises(ValueError):
        paged.tool_loop(Scripted({"text": "I can't"}), "x", ["a"])


def _pages(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "doc_id string, page int, text string")


def _lines(rows):
    return sorted(x for r in rows for x in r.text.split("\n") if x.strip())


def test_every_line_is_in_some_chunk(spark, tmp_path):
    """Few lines are missed in the first batch, which are placed one by one, and many in the second, which is asked anew."""
    for make in (providers.WholePages, Lazy):
        rows = paged.chunk_pages(spark, _pages(spark, *PAGES), str(tmp_path), make, providers.StandAlone, CFG).orderBy("chunk_index").collect()
        assert _lines(rows) == sorted(x for p in PAGES for x in p.split("\n") if x.strip())
        assert [r.chunk_index for r in rows] == list(range(len(rows))) and all(r.length == len(r.text) for r in rows)
    assert {r.type for r in rows} == {"text", "table"}


def test_a_model_places_missed_lines(spark, tmp_path):
    class Merge:
        def fix(self, lines):
            assert all({"id", "text", "before", "after"} <= set(x) for x in lines)
            return [{"id": x["id"], "action": "merge_before"} for x in lines if x["text"] != "total assets"]

    rows = paged.chunk_pages(spark, _pages(spark, *PAGES), str(tmp_path), Lazy, Merge, Config(coverage_retries=0)).orderBy("chunk_index").collect()
    texts = [r.text for r in rows]
    assert texts[0] == "# Report 2020\nfirst line\nsecond line" and texts.count("total assets") == 1
    assert _lines(rows) == sorted(x for p in PAGES for x in p.split("\n") if x.strip())


def test_asked_anew_batches_replace_their_own_only(spark, tmp_path):
    class Forgetful(providers.WholePages):
        """Submits nothing for the second batch until it is told."""

        def reply(self, talk, forced):
            if "第4页" in talk[0]["content"] and "上次遗漏的行" not in talk[0]["content"]:
                return {"tool": "submit_chunks", "chunks": [{"chunk_type": "text", "segments": [{"page": 1, "line_range": [1, 1]}]}, {"segments": "none"}, {"segments": [{"page": 4}]}]}
            return super().reply(talk, forced)

    rows = paged.chunk_pages(spark, _pages(spark, *PAGES), str(tmp_path), Forgetful, providers.StandAlone).orderBy("chunk_index").collect()
    assert [r.page_nums for r in rows] == [[1], [2], [4], [5]]
    assert _lines(rows) == sorted(x for p in PAGES for x in p.split("\n") if x.strip())


def test_words_with_places_become_a_table(spark):
    box = lambda v, c, x, y: {"value": v, "confidence": c, "x1": x, "y1": y, "x2": x + 40, "y2": y + 10}
    words = [box("name", 90, 0, 0), box("sum", 80, 200, 0), box("a", 70, 0, 40), box("5", 100, 200, 40), box("noise", 5, 0, 80)]
    read = spark.createDataFrame([("d", 1, None, words, None, None), ("d", 2, None, None, None, "no page"), ("d", 0, None, None, None, "x")], paged.READ)
    rows = {r.page: r for r in paged.page_results(read).collect()}
    assert rows[1].text == "| name | sum |\n| a | 5 |" and rows[1].tables == [[["name", "sum"], ["a", "5"]]] and rows[1].avg_confidence == 85.0
    assert rows[2].text == "" and rows[2].error == "no page" and set(rows) == {1, 2}


def test_pdfs_from_folder_to_answer(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.pdf").write_bytes(b"%PDF-" + "\f".join([*PAGES, "!"]).encode())
    (folder / "bad.pdf").write_bytes(b"%PDF-!!")
    (folder / "note.txt").write_text("plain words about assets")
    said = []
    docs = Documents(spark, str(tmp_path / "store"), CFG, clock=lambda: datetime(2024, 1, 1))
    assert {r.doc_name: r.error for r in docs.index(str(folder)).collect()} == {"good": NO_READER, "bad": NO_READER, "note.txt": None}
    docs = Documents(spark, str(tmp_path / "store"), CFG, clock=lambda: datetime(2024, 1, 1), reader=Reader, page_model=Lazy, progress=providers.Progress(lambda share, text: said.append(text)))
    rows = {r.doc_name: r for r in docs.index(str(folder)).collect()}
    assert rows["good"].success and rows["good"].num_chunks >= 4 and not rows["good"].skipped
    assert rows["note.txt"].skipped and rows["bad"].error == "no text" and not rows["bad"].success
    assert [t for t in said if "(" not in t] == ["files", "chunks", "index", "catalog"] and len(said) == 8
    assert docs.page_totals().where("pages = 6").count() == 1
    got = Search(docs).search("total assets")
    assert got.status == "success" and any(s["doc_name"] == "good" for s in got.sources)
    assert docs.chunk(1).count() == 1 and docs.chunk(0).count() == 0 and docs.chunk(10_000).count() == 0
    assert {r.op_result for r in docs.audit.read().collect()} == {"success"}


def test_a_run_that_stopped_is_put_right(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.txt").write_text("apples and pears")
    docs = Documents(spark, str(tmp_path / "store"), CFG, clock=lambda: datetime(2024, 1, 1))
    append, docs.files.append = docs.files.append, lambda rows: (_ for _ in ()).throw(OSError("stopped"))
    with pytest.raises(OSError):
        docs.index(str(folder))
    docs.files.append = append
    row = docs.index(str(folder)).first()
    assert row.success and not row.skipped and docs.chunks.read().count() == 1 and docs.lengths.read().count() == 1
    assert docs.postings.read().count() == 3
    assert sorted(r.op_result for r in docs.audit.read().collect()) == ["skipped", "success"]


def test_a_model_gives_the_chapter_titles(spark):
    from lodestar.operators import chunking

    class Titles:
        def ask(self, prompt):
            return "These look like titles.\nregex: ^<<.+>>$"

    text = "<<One>>\nfirst text\n<<Two>>\nsecond text"
    docs = spark.createDataFrame([("a", text), ("b", "no titles at all"), ("c", None)], "doc_id string, text string")
    rows = chunking.chunk_texts(docs, regex_model=Titles).collect()
    assert [(r.chapter_title, r.chapter_index, r.text) for r in rows if r.doc_id == "a"] == [("<<One>>", "1/2", "<<One>>\nfirst text"), ("<<Two>>", "2/2", "<<Two>>\nsecond text")]
    assert [(r.doc_id, r.chapter_title) for r in rows if r.doc_id != "a"] == [("b", None)]


def test_calls_are_made_again():
    calls = []

    class Flaky:
        def ask(self, prompt):
            calls.append(prompt)
            if len(calls) < 3:
                raise ConnectionError
            return "ok"

    assert providers.Retrying(Flaky(), wait=lambda s: None).ask("x") == "ok" and len(calls) == 3


def test_scores_by_a_tool():
    good = json.dumps({"scores": [{"chunk_id": "a", "score": 3, "reason": "r"}]})
    assert providers.ToolScorer(lambda m: ([("submit_scores", good)], 5, 7)).score("q", [("a", "text")]) == ([{"chunk_id": "a", "score": 3, "reason": "r"}], 5, 7)
