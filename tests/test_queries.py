"""Every query against its SQL twin on the smallest tables, and the entry point."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def same(x):
    return round(float(x), 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else x


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.catalog.QUERIES[name](spark, str(SF))
    found = duck.execute(__spark_entry__.catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([same(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([same(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """A copy without tessera/llm, tests/llm and with or without corpus_pipeline.py lists the engine's own queries."""
    root = Path(__spark_entry__.__file__).resolve().parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for there in ("corpus_pipeline.py", None):
        if there and (root / there).exists():
            shutil.copy(root / there, tmp_path)
        elif (tmp_path / "corpus_pipeline.py").exists():
            (tmp_path / "corpus_pipeline.py").unlink()
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
        assert list(map(int, said)) == [len(__spark_entry__.catalog.QUERIES), len(__spark_entry__.catalog.ORACLE)]
