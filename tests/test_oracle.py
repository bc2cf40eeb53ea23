"""Every registered query next to its SQL, at the smallest scale."""

import pytest
from oracle import compare, connect
from tableproof.plans.catalogue import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    problem = compare(spark, duck, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem in (None, "EMPTY"), problem


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r["check_name"]: r["passed"] for r in entry.entry(spark).collect()}
    assert rows["idempotency"] and rows["referential_integrity"] and rows["no_extra_output"]
    assert not rows["content_checksum"] and not rows["key_parity"] and not rows["row_level_sample"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
