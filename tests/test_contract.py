"""Registered queries against their SQL on the smallest driver tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_every_sql_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    text = {n for n in q if n == "pipeline" or n.startswith("op")}
    assert {n for n in q if n not in o} - text == {
        "M07_M08_M09_M10_experiment_metrics", "M10_predictions", "M14_L02_feature_importance", "M16_P28_F13_feature_set_grid",
        "M17_synthetic_rows",
    }


def test_telemetry_stands_without_the_text_operators(tmp_path):
    """A copy without the two folders still imports, with every other query and its SQL."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); print('|'); print(*sorted(e.oracle_sql()), sep='\\n')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120, check=True)
    found, sql = (part.split() for part in done.stdout.split("|"))
    text = lambda n: n == "pipeline" or n.startswith("op")
    assert found == sorted(n for n in entry.queries() if not text(n))
    assert sql == sorted(n for n in entry.oracle_sql() if not text(n))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == want
