"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry
from tradewind.registry.oracles import ORACLES
from tradewind.registry.queries import QUERIES
from tests.compare import connect, difference
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
