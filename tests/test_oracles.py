"""Every core query against its SQL on the smallest tables; the others give rows with a stable schema."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL
from tests.oracle import compare
from visitframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
SLOW = {"validation_report"}  # minutes on one machine: it runs once, not twice


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs_whole(spark, name):
    df = QUERIES[name](spark, SMALL)
    first, again = df.count(), QUERIES[name](spark, SMALL)
    assert df.columns == again.columns and first == again.count() > 0


@pytest.mark.parametrize("name", sorted(SLOW))
def test_runs_once(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row["n_rows"] > row["n_subjects"] > 0
