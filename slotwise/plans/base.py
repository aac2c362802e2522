"""The registry of queries, and the SQL of the model's tables that the twins start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotwise.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BIN = "printf('%02d:%02d', interval_index // 4, interval_index % 4 * 15)"
_COPY = "SELECT site_id, count_date, detector_id, interval_index, volume_15m + 1, source_file_id + 1000000000, 'rec', 1 FROM {0} WHERE source_file_id % 20 = 0"
_RAW = f"""
WITH RECURSIVE own AS (SELECT l_suppkey::INTEGER AS site_id, l_shipdate::DATE AS count_date, l_linenumber::INTEGER AS detector_id, (l_partkey % 96)::INTEGER AS interval_index,
  l_quantity::INTEGER - 2 AS volume_15m, l_orderkey AS source_file_id, CASE WHEN l_shipdate::DATE < DATE '1998-07-01' THEN 'main' ELSE 'cont' END AS source,
  CASE WHEN l_shipdate::DATE < DATE '1998-07-01' THEN 2 ELSE 3 END AS source_priority FROM lineitem),
raw AS (SELECT * FROM own UNION ALL {_COPY.format("own")}),
own_days AS (SELECT user_id::INTEGER AS site_id, ts::DATE AS count_date, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS detector_id,
  (hour(ts) * 4 + minute(ts) // 15)::INTEGER AS interval_index, CASE WHEN event_id % 97 <> 0 THEN floor(value)::INTEGER - 10 END AS volume_15m, event_id AS source_file_id,
  CASE WHEN ts::DATE < DATE '2024-01-16' THEN 'main' ELSE 'cont' END AS source, CASE WHEN ts::DATE < DATE '2024-01-16' THEN 2 ELSE 3 END AS source_priority FROM events),
raw_days AS (SELECT * FROM own_days UNION ALL {_COPY.format("own_days")}),
obs AS (SELECT *, {_BIN} AS time_bin FROM raw WHERE volume_15m >= 0
  QUALIFY row_number() OVER (PARTITION BY site_id, count_date, detector_id, interval_index ORDER BY source_file_id, source_priority) = 1),
obs_days AS (SELECT * REPLACE (CASE WHEN volume_15m >= 0 THEN volume_15m END AS volume_15m), {_BIN} AS time_bin FROM raw_days
  QUALIFY row_number() OVER (PARTITION BY site_id, count_date, detector_id, interval_index ORDER BY source_priority, source_file_id) = 1),
daily AS (SELECT count_date, sum(volume_15m)::BIGINT AS day_total_volume FROM obs GROUP BY 1),
monthly AS (SELECT strftime(count_date, '%Y-%m') AS month_label, sum(volume_15m)::BIGINT AS month_total_volume FROM obs GROUP BY 1),
sm AS (SELECT strftime(count_date, '%Y-%m') AS month_label, site_id, sum(volume_15m)::BIGINT AS month_site_volume FROM obs GROUP BY 1, 2),
st AS (SELECT site_id, sum(volume_15m)::BIGINT AS total_volume FROM obs GROUP BY 1),
bins AS (SELECT time_bin, sum(volume_15m)::BIGINT AS total_volume, count(DISTINCT count_date) AS days_loaded, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS avg_daily_volume FROM obs GROUP BY 1),
dow AS (SELECT isodow(count_date)::INTEGER AS iso_dow, sum(volume_15m)::BIGINT AS total_volume, count(DISTINCT count_date) AS days_loaded, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS avg_daily_volume FROM obs GROUP BY 1),
moy AS (SELECT month(count_date)::INTEGER AS month_of_year, sum(volume_15m)::BIGINT AS total_volume, count(DISTINCT count_date) AS days_loaded, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS avg_daily_volume FROM obs GROUP BY 1),
yearly AS (SELECT year(count_date)::INTEGER AS year, sum(volume_15m)::BIGINT AS total_volume, count(DISTINCT count_date) AS days_loaded, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS avg_daily_volume FROM obs GROUP BY 1),
dow_month AS (SELECT strftime(count_date, '%Y-%m') AS month_label, isodow(count_date)::INTEGER AS iso_dow, sum(volume_15m)::BIGINT AS total_volume, count(DISTINCT count_date) AS days_loaded, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS avg_daily_volume FROM obs GROUP BY 1, 2),
sites AS (SELECT s_suppkey::INTEGER AS site_id, s_name AS site_name, n_name AS municipality, r_name AS region_code,
  CASE WHEN s_suppkey % 13 <> 0 THEN -37.8::DOUBLE + (s_suppkey % 41 - 20) / 1e2 END AS latitude, CASE WHEN s_suppkey % 13 <> 0 THEN 145::DOUBLE + (s_suppkey % 37 - 18) / 1e2 END AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rk AS (SELECT site_id, total_volume, row_number() OVER (ORDER BY total_volume DESC, site_id)::INTEGER AS rank, count(*) OVER () AS sites, sum(total_volume) OVER (ORDER BY total_volume DESC, site_id)::BIGINT AS cumulative_volume, sum(total_volume) OVER ()::BIGINT AS network_volume FROM st)
"""


def add(name: str, make: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Registers a query over the model's tables; ``sql`` follows the tables' definitions (start with a comma to add more of them)."""
    QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
    if sql is not None:
        ORACLES[name] = _RAW + sql
