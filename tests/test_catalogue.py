"""Every registered query on the smallest tables: against its SQL where there is one, otherwise that it runs."""

import os

import pytest

from kalamos.plans import catalogue
from kalamos.session import ship
from tests.compare import DATA, compare, connect

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE])
def test_agrees_with_sql(spark, con, name):
    assert compare(ship(spark), con, catalogue.QUERIES[name], catalogue.ORACLE[name], FOLDER) == ""


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE and n != "retrieval_variants"])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](ship(spark), FOLDER).count() > 0
