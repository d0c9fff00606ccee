"""Registered queries against their SQL on the smallest test tables."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from citeframe.plans.catalog import ORACLES, QUERIES  # noqa: E402
from compare import TABLES, rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    result = con.execute(ORACLES[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_mandates_sharing_criteria_are_checked_once(spark):
    """The check runs on distinct texts; a row without criteria is judged without it."""
    from citeframe.operators.mandates import validate_mandates

    good, bad = '{"asset_types": ["Land", "castle"]}', '{"asset_types": ["land"]}'
    rows = [(1, "a", good), (2, "", good), (3, "c", bad), (4, "d", None), (5, "e", "[]"), (6, "f", bad)]
    df = spark.createDataFrame(rows, "mandate_id int, name string, criteria string").selectExpr("*", "cast(null as string) description")
    checked = validate_mandates(df)
    assert {r.mandate_id: (r.errors, r.asset_types) for r in checked.collect()} == {
        1: (["asset_types: unknown castle"], ["Land"]),
        2: (["name: not 1 to 120 characters", "asset_types: unknown castle"], ["Land"]),
        3: ([], ["Land"]), 6: ([], ["Land"]),
        4: (["criteria: not an object"], []), 5: (["criteria: not an object"], []),
    }
    assert "Aggregate [" in checked._jdf.queryExecution().optimizedPlan().toString()


def test_profile_texts_are_matched_once(spark):
    from citeframe.operators.vocabulary import with_profile_market

    rows = [(1, "Boise", None, "Tucson", " "), (2, None, "Tucson", "Boise", "x"), (3, None, None, None, None), (4, "x", " ", None, "Tucson, AZ")]
    found = with_profile_market(spark.createDataFrame(rows, "id int, market string, submarket string, location string, address string"))
    assert {r.id: r.profile_market and (r.profile_market.market, r.profile_market.field) for r in found.collect()} == {
        1: ("Boise", "market"), 2: ("Tucson", "submarket"), 3: None, 4: ("Tucson", "address"),
    }
    assert "parquet" in found._jdf.queryExecution().optimizedPlan().toString()
