"""The driver's contract: queries run, columns and values match their SQL, the llm part may be missing."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["part", "lineitem", "orders", "customer", "events", "documents", "pages", "labels", "conversations", "benchmark"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_optional_part():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quillspark.llm'): raise ModuleNotFoundError(name, name='quillspark.llm' if 'llm' in name else name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'q01_fold_keys' in e.queries() and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
