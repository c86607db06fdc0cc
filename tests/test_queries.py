"""Every registered query against its SQL, over the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lodestar.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x01".join("∅" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    if sql := registry.oracle_sql().get(name):
        got = con.execute(sql)
        columns = [d[0] for d in got.description]
        assert sorted(df.columns) == sorted(columns)
        assert canon(rows, df.columns) == canon(got.fetchall(), columns)
    assert len(df.columns) == len(set(df.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_library_doesnt_import_llm():
    root = Path(__file__).resolve().parent.parent / "lodestar"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lodestar.llm" not in path.read_text()


@pytest.mark.parametrize("gone", [["lodestar/llm", "tests/llm"], ["lodestar/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_llm_folders(tmp_path, gone):
    """In another interpreter, over a copy of the repository: all other queries are there, and one runs."""
    root = Path(__file__).resolve().parent.parent
    for name in ("lodestar", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True)
    code = f"""
import __spark_entry__ as e
from lodestar.plans import registry
from lodestar.session import local
assert e.__file__.startswith({str(tmp_path)!r})
names, sql = set(e.queries()), set(e.oracle_sql())
assert names >= set(registry.queries()) and sql >= set(registry.oracle_sql())
assert "pipeline" not in names | sql
assert ({"lodestar/llm" in gone}) == (names == set(registry.queries()))
spark = local(1, partitions=1, memory="1g")
assert e.queries()["group_listing"](spark, {SF!r}).count() and e.entry(spark).columns
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))} | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
