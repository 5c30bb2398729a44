"""The queries that SQL can express against their DuckDB twins."""

import pytest

from ledgerloom.llm.queries import load
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, key):
    status, _, _, note = compare(spark, connect(SF_DIR), SF_DIR, key, QUERIES[key], ORACLES[key])
    assert status == "ok", note
