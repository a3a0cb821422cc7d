"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from chromaspan.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    norm = lambda v: None if v is None or v != v else v if isinstance(v, str) else round(float(v), 9)
    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, db, name):
    mine, theirs = rows(Q.QUERIES[name](spark, SF).toPandas()), rows(db.sql(Q.SQL[name]).df())
    assert mine == theirs
    assert mine[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
