"""Every catalogue query against its DuckDB oracle (the driver's correctness gate)
at sf0.001 (always) and sf0.01 (set MOPUP_FULL=1)."""

import os

import pytest

from mopup.plans.catalog import QUERIES
from mopup.plans.oracles import oracles

from .oracle_compare import compare, duck

SFS = ["/root/testdata/sf0.001"] + (["/root/testdata/sf0.01"] if os.environ.get("MOPUP_FULL") else [])
ORACLES = oracles()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module", params=SFS)
def con(request):
    return request.param, duck(request.param)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    sf, c = con
    r = compare(spark, c, name, sf, QUERIES[name], ORACLES[name])
    assert r["ok"], r
