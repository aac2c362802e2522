"""Queries against their SQL twins in DuckDB, over the smallest tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from slotwise.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)



def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in order)]) for r in rows)


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of every query, or what it raised; several at a time, over several partitions."""

    def run(name):
        try:
            got = QUERIES[name](spark, FOLDER)
            return got.columns, got.collect()
        except Exception as e:  # noqa: BLE001
            return e

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(NAMES, pool.map(run, NAMES), strict=True))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(results, name):
    if isinstance(results[name], Exception):
        raise results[name]
    columns, rows = results[name]
    db = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.sql(ORACLES[name])
    assert sorted(columns) == sorted(want.columns)
    assert _rows(columns, rows) == _rows(want.columns, want.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_breakdowns_sum_to_the_total(spark):
    if not Path(FOLDER).exists():
        pytest.skip("needs the test tables")
    total = QUERIES["total_volume"](spark, FOLDER).first()[0]
    for name, column in (("daily_totals", "day_total_volume"), ("monthly_totals", "month_total_volume"), ("site_totals", "total_volume"), ("time_bin_totals", "total_volume")):
        assert sum(r[column] for r in QUERIES[name](spark, FOLDER).collect()) == total


HEADLINES = ["total_volume", "daily_totals", "monthly_totals", "site_totals", "site_month_totals", "time_bin_profile", "day_of_week_profile", "month_of_year_profile", "yearly_totals", "weekday_weekend_split", "peak_shares", "best_day", "best_site", "growth_by_year"]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", HEADLINES)
def test_headlines_read_the_cubes(spark, name):
    """No scan of the facts, no exchange of observations, no sorting aggregation."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "slotwise-cubes" in plan and "lineitem" not in plan and "SortAggregate" not in plan and "detector_id" not in plan


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["stored_period_summary", "stored_window_totals"])
def test_store_reads_list_their_months_only(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "slotwise-stores" in line]
    assert scans and all("PartitionFilters: []" not in line for line in scans)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
def test_intensity_band_keeps_every_row(results):
    """One row a site, date and slot of the pulse, not a summary of the bands."""
    columns, rows = results["intensity_band"]
    assert columns == ["site_id", "count_date", "time_bin", "volume", "intensity_band"]
    assert len(rows) == len(results["enrich_pulse"][1])
