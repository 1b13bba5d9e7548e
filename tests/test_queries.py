"""Every query of the core with an SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from rankloom.plans import registry
from verify import norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    got = registry.queries()[name](spark, SF).toPandas()
    twin = registry.oracle_sql().get(name)
    if twin is None:
        assert len(got.columns) > 0
        return
    want = sql.execute(twin).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_packing_in_parts(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = registry.queries()["batch_pack_parts"](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    one = registry.queries()["batch_pack"](spark, SF).toPandas()
    assert got.part.nunique() > 1 and sorted(got.solution_key) == sorted(one.solution_key)
    for _, b in got.groupby(["part", "batch"]):
        assert len(b) == 1 or len(b) * (b.num_tokens.max() + 8 - b.num_tokens.max() % 8) <= 4096
