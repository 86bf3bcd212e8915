"""Every registered query against its SQL oracle, over whole tables at the smallest scale."""

from pathlib import Path

import pytest

from workloads.compare import connect, difference
from workloads.oracles import ORACLES
from workloads.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(SF_DIR).is_dir():
        pytest.skip("no test tables")
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_oracle(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None
