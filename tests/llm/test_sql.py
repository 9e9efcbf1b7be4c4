"""The queries that SQL can express against it, on the smallest tables."""

import duckdb
import pytest

from vendorlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    plain = lambda x: round(float(x), 9) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    rows = lambda found, columns: sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found), key=str)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), names)
