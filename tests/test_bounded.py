"""Streams over tables that are folders of files."""

from __future__ import annotations

import pytest

from parley.plans import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name, table", [("service_words", "conversations"), ("changed_tables", "events")])
def test_streams_read_folders(spark, duck, sf_dir, tmp_path, name, table):
    """A table of several files gives its stream all rows, as a table of one file does."""
    spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    same_rows(catalog.queries()[name](spark, str(tmp_path)), duck, catalog.oracle_sql()[name])


def test_deliveries_are_not_grouped(spark):
    """Every row of events is sent once to each endpoint, whose wishes may repeat and overlap."""
    from parley.sources.meetings import deliveries

    events = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "y"), (3, "*", "z")], "event long, kind string, payload string")
    subs = spark.createDataFrame([("all", []), ("all", ["a"]), ("some", ["a", "a", "b"]), ("none", ["c"])], "endpoint string, kinds array<string>")
    got = sorted((r["endpoint"], r["event"]) for r in deliveries(events, subs).collect())
    assert got == [("all", 1), ("all", 1), ("all", 2), ("all", 3), ("some", 1), ("some", 1), ("some", 2)]


def test_medians_hold_no_group(spark, duck, sf_dir):
    """No aggregate holds the prices or customers of a whole group, and the rows are those of SQL."""
    plan = catalog.queries()["approximate_counts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan and "count(distinct" not in plan
    same_rows(catalog.queries()["approximate_counts"](spark, sf_dir), duck, catalog.oracle_sql()["approximate_counts"])
