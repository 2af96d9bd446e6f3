"""Every query with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest
from duelframe import queries, queries_files, queries_models
from duelframe import queries as Q

from ..conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


QUERIES = {**queries.queries(), **queries_models.queries(), **queries_files.queries()}
SQL = {**queries.oracle_sql(), **queries_models.oracle_sql(), **queries_files.oracle_sql()}


def rows(values):
    return sorted((tuple(v) for v in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]}) q").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_event_has_ratings(spark):
    got = {r.event_id for r in Q.fitted_ratings(spark, SF).select("event_id").distinct().collect()}
    assert got == {r.tournament_id for r in Q.event_universe(spark, SF).select("tournament_id").collect()} and len(got) > 50


@pytest.mark.parametrize("name", ["consumer_rows", "csv_flags", "csv_outcomes", "event_standings", "gradient_step", "modal_tiers", "promoted_view", "rating_hessian", "reference_coverage", "unordered_pairs"])
def test_prices_that_doubles_hold_a_little_below_their_cents(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql("CREATE TABLE supplier AS SELECT i AS s_suppkey, 'S' || i AS s_name FROM range(1, 6) r(i)")
    con.sql("CREATE TABLE orders AS SELECT i AS o_orderkey, TIMESTAMP '1995-01-01' + to_days(CAST(i AS INT)) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(102, 190) r(i)")
    # 0.29 * 100 is below 29: cut, the sum of supplier 4 would be that of supplier 2, whose number is smaller.
    con.sql("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, s AS l_suppkey, p AS l_extendedprice FROM orders, (VALUES (CAST(4 AS BIGINT), CAST(0.29 AS DOUBLE)), (2, 0.28), (5, 0.10), (1, 0.57)) v(s, p) WHERE s <> 1 OR o_orderkey % 2 = 0")
    for t in ("supplier", "orders", "lineitem"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got, want = rows(df.select(*columns).collect()), con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]}) q").fetchall()
    assert got == rows(want) and got
