"""Every registered query against its SQL, and the ones without SQL for their shape."""

import os

import pytest

import check
from tallyrank.catalog.oracle import SQL
from tallyrank.catalog.queries import REGISTRY


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) & set(SQL)))
def test_matches_sql(spark, sf_dir, con, name):
    verdict = check.compare(REGISTRY[name](spark, sf_dir), con, SQL[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
@pytest.mark.skipif(not os.environ.get("TEST_FULL_MODELS"), reason="hundreds of boosting rounds; set TEST_FULL_MODELS")
def test_gives_rows(spark, sf_dir, name):
    df = REGISTRY[name](spark, sf_dir)
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(REGISTRY)
