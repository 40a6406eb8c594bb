"""Every query against the SQL that states the same result, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from corvane.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}") if not isinstance(x, int) else x
    return str(x)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    r = duck.execute(ORACLES[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    want = sorted((tuple(plain(row[at.index(c)]) for c in cols) for row in r.fetchall()), key=str)
    got = sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, float(y), rel_tol=1e-6, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["wn3_greedy_matching", "ag9_match_metrics", "ag11_coco_statistics", "so7_suppression", "ag17_fusion_provenance", "wn9_review_list", "wn10_middle_records", "sm4_balanced_groups", "ud3_tiled_provider"])
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_names_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
