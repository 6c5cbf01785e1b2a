"""Every query with SQL returns the rows that DuckDB does, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tallyspan.plans import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    got = rows(df.columns, df.collect())
    assert got
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_queries_take_every_event(spark, duck):
    ids = {str(i) for (i,) in duck.sql("select event_id from events").fetchall()}
    got = {name: catalog.QUERIES[name](spark, str(SF)).collect() for name in ("q03_id_idempotency", "q05_batch_keys", "q18_requeue")}
    assert {r.id for r in got["q03_id_idempotency"]} == {i for i in ids if int(i) % catalog.CUT == 0}
    batch = {r.id for r in got["q05_batch_keys"]}
    assert batch | {r.returned for r in got["q05_batch_keys"]} == ids
    assert sorted(r.id for r in got["q18_requeue"]) == sorted(ids | {"x" + i for i in ids})
    assert {r.outcome for r in got["q18_requeue"]} == {"ok", "not_found", "live_conflict", "key_held"}


def test_identifiers_of_leases_beyond_a_long(spark, tmp_path):
    """Keys around 3074 and 9223, the last whose lease and whose third of it are longs; the SQL ends with the first one."""
    keys = [0, 1, 2, 3, 3073, 3074, 3075, 3076, 9222, 9223, 9224, 9225, 14999, 900000, 2**63 - 1]
    spark.createDataFrame([(k, f"Customer_{k}") for k in keys], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    df = catalog.QUERIES["q63_identifiers"](spark, str(tmp_path))
    got = {r.c_custkey: r for r in df.collect()}
    assert dict(df.dtypes)["heartbeat"] == "bigint"
    assert {k: r.heartbeat for k, r in got.items()} == {k: min(max(k * 3000000000000001 // 3, 50_000_000), 2**63 - 1) for k in keys}
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet' where c_custkey <= 3074")
    rel = con.sql(catalog.ORACLES["q63_identifiers"])
    assert rows(df.columns, [r for k, r in got.items() if k <= 3074]) == rows(rel.columns, rel.fetchall())
