"""Queries that SQL can express against their DuckDB oracles."""

import pytest

from mopup.llm.queries import ORACLES, QUERIES

from ..oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    r = compare(spark, duck(SF), name, SF, QUERIES[name], ORACLES[name])
    assert r["ok"], r


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
