"""Every registered query against its SQL oracle at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from ledgerloom.plans import registry  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    status, n, _, note = compare(spark, con, SF_DIR, key, QUERIES[key], ORACLES.get(key))
    assert status in ("ok", "rows"), f"{key}: {status} {note}"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
