"""Every registered query against its SQL on the smallest tables, at several partition counts for some."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidecohort.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    return sorted((tuple(None if v is pd.NA or v is pd.NaT or isinstance(v, (float, np.floating)) and v != v else v for v in r) for r in frame[names].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA), duck.sql(registry.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.toPandas()) == rows(theirs.df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert len(registry.QUERIES[name](spark, DATA).toPandas())


@pytest.mark.parametrize("name", ["window_plan_budget", "anomaly_rrf", "subject_psd", "kernel_win_counts"])
def test_same_at_any_partitioning(spark, name):
    found = []
    for n in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        found.append(rows(registry.QUERIES[name](spark, DATA).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2]
