"""Every query against the SQL that checks it, on the smallest tables."""

import os

import compare
import pytest

from rulegrain.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("RULEGRAIN_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare.difference(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
