"""Every query of the package against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from aerolith.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((rounded(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert got
        return
    want = con.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((rounded(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.fixture
def without_llm(tmp_path):
    """A copy of the repository in which the corpus parts are gone."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in ("aerolith", "tests", "__spark_entry__.py", "bench.py"):
        src = os.path.join(root, p)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / p)
    for p in ("aerolith/llm", "tests/llm"):
        shutil.rmtree(tmp_path / p, ignore_errors=True)
    return tmp_path


def _run(folder, *command):
    import subprocess
    import sys

    env = {k: x for k, x in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, *command], cwd=folder, env=env, capture_output=True, text=True)


def test_entry_without_the_llm_parts(without_llm):
    """The entry module imports and lists the other queries when those parts are gone, and the other tests work."""
    shown = ("-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))")
    out = _run(without_llm, *shown)
    assert out.returncode == 0, out.stderr
    n, m, any_llm = out.stdout.split()
    assert int(n) == len(registry.QUERIES) and int(m) == len(registry.SQL) and any_llm == "False"
    tests = _run(without_llm, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", "observations_scan or zone_summary or payload_parity")
    assert tests.returncode == 0 and "3 passed" in tests.stdout, tests.stdout[-2000:]


def test_an_error_within_the_llm_parts_is_not_hidden(without_llm):
    (without_llm / "aerolith" / "llm").mkdir()
    for name, text in (("__init__.py", ""), ("queries.py", "import no_such_module_at_all")):
        (without_llm / "aerolith" / "llm" / name).write_text(text)
    out = _run(without_llm, "-c", "import __spark_entry__")
    assert out.returncode != 0 and "no_such_module_at_all" in out.stderr
