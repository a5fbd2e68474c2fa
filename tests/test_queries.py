"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from kinfold.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    return sorted((tuple(str(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    found = [x[0] for x in cursor.description]
    assert sorted(found) == columns
    wanted = rows_of(columns, [[r[found.index(c)] for c in columns] for r in cursor.fetchall()])
    assert rows_of(columns, [[r[c] for c in columns] for r in df.collect()]) == wanted


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
