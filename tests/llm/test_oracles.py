"""The operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from contractlens.llm import queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def same(df, cur):
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck.execute(queries.oracle_sql()[name]))


def test_small_shards(spark, duck):
    out = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), limit=60_000)
    picked = out.selectExpr("doc_id", "cast(shard_bits as int) as shard_bits", "shard_prefix", "shard_bytes", "shard_piece")
    same(picked, duck.execute(sharding.oracle(60_000)))
