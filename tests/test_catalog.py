"""Each registered query against its SQL on an independent engine."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sonolith.plans import catalog, signals  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events embeddings".split()
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, bool | str):
        return str(v)
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, engine, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    engine.execute(catalog.ORACLES[name])
    at = {d[0]: k for k, d in enumerate(engine.description)}
    assert sorted(at) == names
    want = sorted(tuple(plain(r[at[n]]) for n in names) for r in engine.fetchall())
    assert got == want and got


@needs_data
def test_frames_cover_every_event(spark):
    n = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert catalog.QUERIES["windowed_frames"](spark, FOLDER).count() == n
    spectra = [catalog.QUERIES[name](spark, FOLDER) for name in ("dft8_frames", "fft8_frames")]
    frames = catalog.QUERIES["windowed_frames"](spark, FOLDER).select("signal_id", "frame").distinct().count()
    assert [x.count() for x in spectra] == [8 * frames] * 2


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_columns_and_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["arith_float"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double>" in plan
    plan = catalog.table(spark, FOLDER, "lineitem").where("l_tax > 0.05").select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_tax" in plan
