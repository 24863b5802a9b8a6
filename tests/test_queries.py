"""Every registered query with a DuckDB text gives the same rows as it on the smallest tables."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

from lakeloom import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return dt.datetime(value.year, value.month, value.day)
    return value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(repr([plain(v) for v in row]) for row in found.fetchall())
    ours = sorted(repr([plain(v) for v in row]) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    assert ours == theirs


def test_division_by_zero_of_null_negative_and_odd_numbers(spark, tmp_path):
    path = f"{tmp_path}/lineitem.parquet"
    duckdb.sql(f"COPY (SELECT k AS l_orderkey, 1::INTEGER AS l_linenumber, d AS l_discount FROM (VALUES (NULL::BIGINT), (0), (1), (2), (3), (-1), (-2), (-3)) a(k), (VALUES (0.1::DOUBLE), (NULL), ('nan'), ('inf')) b(d)) TO '{path}' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    theirs = sorted(map(repr, c.execute(catalogue.oracle_sql()["calc_division_by_zero"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in catalogue.queries()["calc_division_by_zero"](spark, str(tmp_path)).collect()) == theirs


def test_entry_points_work_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for item in ("lakeloom", "__spark_entry__.py"):
        source = os.path.join(root, item)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / item)
    shutil.rmtree(tmp_path / "lakeloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert not any(n.startswith('op1') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
