"""Registered queries against their SQL on the smallest tables; the SQL answers are computed by DuckDB."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from voluma.plans import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def key(row):
    return [round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in row]


@pytest.mark.parametrize("name", ["flagship", "st_3dfaces", "st_3dvolume_guarded", "st_3dvalidationreport", "st_3ddistance", "st_3dintersects", "st_3dtransform", "st_3drotatez", "st_3dtranslate", "st_3dconvexhull", "agg_extent_grouped", "join_dwithin_grid", "cast_payload", "struct_sidecar", "try_twin", "crs_rule", "nested_solids", "holed_and_warped", "st_3denvelope", "st_3dfootprintarea"])
def test_against_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(key, df.select(*columns).collect())))
    want = sorted(map(repr, map(key, tables.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]}) AS q").fetchall())))
    assert got == want


def test_every_function_has_a_query():
    from voluma.functions import library

    assert set(library.PUBLIC) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "volume", "footprint", "height"]
    assert df.count() > 0
