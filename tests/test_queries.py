"""The registered queries, and the SQL that gives the same rows."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from pagestrata import config
from pagestrata.functions import text
from pagestrata.operators.snippets import SNIPPETS, WITHOUT, with_snippets
from pagestrata.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value.isoformat()[:19].replace("T00:00:00", "") if hasattr(value, "isoformat") else value


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("gone", [("pagestrata/llm", "tests/llm"), ("pagestrata/llm", "tests/llm", "corpus_pipeline.py")])
def test_registry_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns("__pycache__", ".git", ".pytest_cache", "spark-warehouse")
    shutil.copytree(Path(contract.__file__).parent, copy, ignore=skip)
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    said = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", said], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout.splitlines()
    assert out[0].split() == sorted(QUERIES) and out[1].split() == sorted(ORACLE_SQL)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    """Queries without SQL run as they are registered."""
    found = QUERIES[name](spark, DATA)
    assert len(set(found.columns)) == len(found.columns) and found.collect()


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = QUERIES[name](spark, DATA)
    cursor = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=repr) == want


@needs_data
def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(0 <= r["totalScore"] <= 30 for r in rows)


def test_snippets(spark):
    keys = {k for k, *_ in config.FINDINGS}
    assert len(SNIPPETS) == 19 and set(SNIPPETS) | set(WITHOUT) <= keys and not set(SNIPPETS) & set(WITHOUT)
    found = with_snippets(spark.createDataFrame([("no_h1",), ("bad_hierarchy",)], "key string")).collect()
    assert found[0]["snippet"]["language"] == "html" and found[1]["snippet"] is None


def test_short_texts(spark):
    from pyspark.sql import functions as F

    long = "Some words that go on, and on, and on until the line is far too long to show"
    df = spark.createDataFrame([(long,), ("  short  one ",), ("x" * 70,)], "t string")
    rows = df.select(text.clip(F.col("t")), text.excerpt(F.col("t"))).collect()
    assert [r[1] for r in rows] == ["Some words that go on, and on, and on until the line is…", "short one", "x" * 59 + "…"]
    assert all(len(r[0]) <= 60 for r in rows)
    links = spark.createDataFrame([([(f"https://www.h{i % 7}.org/x",) for i in range(9)],)], "l array<struct<href: string>>")
    assert links.select(text.host_list(F.col("l"))).head()[0] == "h0.org, h1.org, h2.org, h3.org, h4.org …"
