"""The queries that SQL can express, against their SQL."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from mmspark.llm import queries as Q  # noqa: E402

TABLES = ("documents", "embeddings", "pages")


def against_sql(spark, folder, name):
    found = Q.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.sql(Q.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, name, size):
    against_sql(spark, f"/root/testdata/{size}", name)
