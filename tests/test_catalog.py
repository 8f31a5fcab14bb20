"""Every registered query of the library against its DuckDB SQL at the smallest scale."""

from __future__ import annotations

import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
if not os.path.isdir(SF):
    pytest.skip("no test tables", allow_module_level=True)

from exprflow import registry  # noqa: E402
from exprflow.plans import catalog, curation, discovery, evaluation, models, ranking, regions, resolution  # noqa: E402, F401


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if pd.isna(v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, float) else str(v)


def rows(pdf):
    return sorted(tuple(norm(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [x.replace(".0", "") for r in rows(got) for x in r] == [x.replace(".0", "") for r in rows(want) for x in r]


def test_whole_queries_cover_their_tables(spark):
    got = registry.queries()["nearest_labels_twentieth"](spark, SF).select("query_id").distinct().count()
    assert got == spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    got = registry.queries()["combined_matrices_whole"](spark, SF).select("sample_id").distinct().count()
    assert got == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
