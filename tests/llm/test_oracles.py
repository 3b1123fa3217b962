import duckdb
import pytest

from marlow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())
