"""Every query of the catalogue against its SQL, over the smallest tables; those without SQL give rows of a stable schema."""

import pytest

from tessera.plans import catalogue
from tests.conftest import DATA, same

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert same(QUERIES[name](spark, f"{DATA}/sf0.001"), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.columns and df.count() > 0


def test_flagship(spark):
    assert catalogue.FLAGSHIP in QUERIES


def test_banner_state_of_every_series(spark):
    from tessera.plans import surrogates as G

    sf = f"{DATA}/sf0.001"
    got = QUERIES["banner_state_all"](spark, sf).collect()
    assert len(got) == G.fs(spark, sf).count() and len({r.video_id for r in got}) > 1


def test_window_cover_shows_the_second_window(spark):
    got = QUERIES["window_cover_all"](spark, f"{DATA}/sf0.001").collect()
    assert {r.window for r in got} == {1, 2}
