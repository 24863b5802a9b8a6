"""Registered queries: the SQL counterparts on the smallest tables, and the shape of the registry."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__
from lakeloom.llm import catalogue, store

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = catalogue.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))
    assert "pipeline" in names and set(names) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = catalogue.queries()[name](spark, FOLDER)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_tables_are_cleared(spark):
    df = store.materialise(spark.range(3), "range")
    assert df.count() == 3
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert os.listdir(f"{folder}/lakeloom/{spark.sparkContext.applicationId}")
    store.clear(spark)
    assert not os.path.exists(f"{folder}/lakeloom/{spark.sparkContext.applicationId}")
