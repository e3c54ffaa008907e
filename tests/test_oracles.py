"""Every query of the catalogue against its SQL, on whole tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidemark import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "events", "embeddings", "nation", "region", "part", "supplier")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000") if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, DIR)
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    want = cursor.fetchall()
    assert rows(got.columns, got.collect()) == rows([d[0] for d in cursor.description], want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() >= 0


def test_every_query_but_the_learned_ones_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"q_logistic", "q_boosted", "q_forest"}
