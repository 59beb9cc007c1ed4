"""Every registered query against its SQL, and the package without its training-data subpackage."""

import math
import os
import subprocess
import sys
import textwrap

import duckdb
import pytest

from glyphmill import registry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("documents", "embeddings", "benchmark", "conversations", "nation")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def told(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(tuple(str(told(r[c])) for c in sorted(df.columns)) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert got == sorted(tuple(str(told(r[k])) for k in at) for r in want.fetchall())


def test_without_the_subpackage():
    code = """
        import sys
        class Absent:
            def find_spec(self, name, path=None, target=None):
                if name.startswith(("glyphmill.llm", "corpus_pipeline")):
                    raise ModuleNotFoundError(name)
        sys.meta_path.insert(0, Absent())
        import __spark_entry__ as e
        assert "bpe_train" in e.queries() and "bpe_train" in e.oracle_sql()
        assert not any(k.startswith("op") or k == "pipeline" for k in e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=ROOT)
