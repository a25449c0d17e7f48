from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA, normal
from winlens.plans import registry

ORACLES = registry.oracles()
AT_ONCE = 4


@pytest.fixture(scope="module")
def results(spark):
    """Results of all queries that have SQL, or what they raised. Spark runs some at a time, as jobs of so few rows leave cores idle."""

    def run(name):
        try:
            return registry.queries()[name](spark, DATA).toPandas()
        except Exception as e:  # noqa: BLE001  raised by the test of the query
            return e

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(ORACLES, pool.map(run, ORACLES), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(results, duck, name):
    ours = results[name]
    if isinstance(ours, Exception):
        raise ours
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours).equals(normal(theirs))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 8
