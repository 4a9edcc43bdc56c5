"""Driver contract: entry() runs on sf0.001; every query has a callable; oracle keys are queries."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_contract_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) > 80
    assert set(sql) <= set(qs)


def test_oracle_sql_plans_in_duckdb():
    import duckdb

    from tests.conftest import SF_SMALL

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in E.oracle_sql().items():
        con.execute("EXPLAIN " + sql)  # raises on any syntax / binding error
