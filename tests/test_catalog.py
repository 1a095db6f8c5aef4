"""Every query of the library runs, and equals its SQL where there is one."""

from __future__ import annotations

import pytest

from parley.plans import catalog
from tests.conftest import same_rows

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_its_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) > 0
    df.count()


def test_stemming_is_not_claimed():
    """Terms are folded, not stemmed."""
    assert "sf_tokenize_lang" not in {i for ids in catalog.COVERS.values() for i in ids}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
