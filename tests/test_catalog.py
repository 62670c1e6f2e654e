"""Every query with SQL gives DuckDB's rows; the others give rows with a stable schema."""

import pytest

from tests.conftest import SMALL
from tests.oracle import compare, connect
from zonaris.plans import catalog, documents, planning, polygons, relational, studies, textual  # noqa: F401  (they add to the catalogue)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name in catalog.ORACLE_SQL:
        assert compare(df, catalog.ORACLE_SQL[name], connect(SMALL)) == ""
    else:
        assert df.columns and df.count() >= 0


def test_docstrings_claim_no_open_method():
    open_codes = {"doc_segments": "D1 D3 D13", "html_records": "S20", "manifest_hashes": "S31", "upsert_last_wins": "U10", "stream_first_of_key": "R1"}
    for name, codes in open_codes.items():
        assert not set(codes.split()) & set(catalog.QUERIES[name].__doc__.replace(":", " ").replace(",", " ").split())


def test_the_last_state_is_of_all_orders(spark):
    larger = "/root/testdata/sf0.01"
    df = catalog.QUERIES["as_of_last_state"](spark, larger)
    assert compare(df, catalog.ORACLE_SQL["as_of_last_state"], connect(larger)) == ""
    assert df.where("o_orderkey > 2000").count() > 0
