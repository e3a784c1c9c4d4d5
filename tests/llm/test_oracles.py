import duckdb
import pytest

from tamiz.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, small, name, size):
    sf, db = small.replace("sf0.001", size), duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    found = db.execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
