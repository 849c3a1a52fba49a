"""Every operator has a query, and every query agrees with its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry_points
from catalog import ORACLES, QUERIES
from tools.check_oracles import compare, duck

DATA = "/root/testdata/sf0.001"
IDS = ([f"s{i}" for i in range(1, 11)] + [f"p{i}" for i in range(1, 7)] + [f"m{i}" for i in range(1, 8)] +
       [f"d{i}" for i in range(1, 10)] + [f"f{i}" for i in range(1, 15)] + [f"e{i}" for i in range(1, 7)] +
       [f"r{i}" for i in range(1, 6)] + [f"c{i}" for i in range(1, 12)] + [f"v{i}" for i in range(1, 5)])


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_every_operator_has_a_query():
    assert len(IDS) == 72
    for wanted in IDS:
        assert any(name.startswith(f"{wanted}_") for name in QUERIES), wanted


def test_entry_points():
    assert entry_points.queries().keys() >= QUERIES.keys() and entry_points.oracle_sql().items() >= ORACLES.items()
    assert set(ORACLES) <= set(QUERIES)
    assert not any(re.match(r"op\d|pipeline", name) for name in QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], DATA) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_gives_rows(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], None, DATA) is None
