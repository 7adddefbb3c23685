"""Every registered query against its SQL on the smallest data set."""

import pytest

from tests.oracle import duck, mismatch
from workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert frame.count() > 0
        return
    rows, difference = mismatch(frame, con, ORACLES[name])
    assert difference is None
    assert rows > 0
