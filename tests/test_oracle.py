"""Every registered query against its DuckDB oracle on the smallest tables.

The driver runs the same comparison at sf0.01 (``python tests/oracle_compare.py``).
"""

import os

import pytest

os.environ.setdefault("ORACLE_STRICT", "1")  # doubles compared at full precision
from tests.oracle_compare import compare, duck  # noqa: E402
from wavepanel.plans.registry import load_all  # noqa: E402

SF = "/root/testdata/sf0.001"
REG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, con, name):
    fn, q = REG[name]
    info = compare(spark, con, name, fn, q, SF)
    assert info["ok"] is not False, info
    assert "types" not in info, info
