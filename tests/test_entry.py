import duckdb
import pytest

import __spark_entry__ as entry
from genoloom import queries

SF = "/root/testdata/sf0.001"


def canonical(v):
    if v is None or str(v) in ("<NA>", "nan", "NaT"):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.tolist() if hasattr(v, "tolist") else v


def same(df, sql: str, sf: str = SF) -> None:
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(sql).df(), df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda t: sorted((tuple(map(canonical, r)) for r in t[sorted(got.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


def test_entry(spark):
    assert {r["class"] for r in entry.entry(spark).collect()} == {"core", "soft_core", "shell", "cloud", "total"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
