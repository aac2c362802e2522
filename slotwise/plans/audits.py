"""Queries: data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import audits as A
from slotwise.operators import core
from slotwise.operators import ordered as O
from slotwise.plans.base import add
from slotwise.plans.profiles import _WIDE, _r6

K = "site_id, count_date, detector_id, interval_index"
_COLUMNS = [*core.KEYS, "volume_15m", "source_file_id", "source", "source_priority"]
add("row_counts", lambda t: A.row_counts({"raw": t.raw, "raw_days": t.raw_days}), "SELECT count(*) AS n_rows, 'raw' AS table_name FROM raw UNION ALL SELECT count(*), 'raw_days' FROM raw_days")
add("coverage_dates", lambda t: t.raw.agg(F.min("count_date").alias("first_date"), F.max("count_date").alias("last_date"), F.countDistinct("count_date").alias("dates")), "SELECT min(count_date) AS first_date, max(count_date) AS last_date, count(DISTINCT count_date) AS dates FROM raw")
add("coverage_keys", lambda t: A.distinct_counts(t.raw, {"site_id": "sites", "detector_id": "detectors", "source_file_id": "files"}), "SELECT count(DISTINCT site_id) AS sites, count(DISTINCT detector_id) AS detectors, count(DISTINCT source_file_id) AS files FROM raw")
add("null_counts", lambda t: A.null_counts(t.raw_days, _COLUMNS), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM raw_days" for c in _COLUMNS))
_FULL = ["site_id", "count_date", "detector_id", "source_file_id", "source"]
_BARE = ["region_code", "ct_records", "volume_24hour", "alarm_24hour"]
add(
    "null_counts_wide",
    lambda t: A.null_counts(t.stored.select(*_FULL, *_BARE, *[F.get("slots", F.lit(i)).alias(f"v{i:02d}") for i in range(96)]), [*_FULL, *_BARE, *[f"v{i:02d}" for i in range(96)]]),
    _WIDE + ", dd AS (SELECT count(DISTINCT (source, site_id, count_date, detector_id)) AS n FROM w), f AS (SELECT interval_index, count(v) AS c FROM w GROUP BY 1) SELECT printf('v%02d', s) AS column_name, n - coalesce(c, 0) AS nulls FROM dd CROSS JOIN range(0, 96) r(s) LEFT JOIN f ON interval_index = s "
    + "".join(f"UNION ALL SELECT '{c}', {'n' if c in _BARE else '0'} FROM dd " for c in [*_FULL, *_BARE]),
)
add("duplicate_excess", lambda t: A.duplicate_excess(t.raw, core.KEYS), f"SELECT sum(n)::BIGINT AS n_rows, count(*) AS distinct_keys, sum(n - 1)::BIGINT AS duplicate_excess FROM (SELECT count(*) AS n FROM raw GROUP BY {K})")
add("duplicate_groups", lambda t: A.duplicate_groups(t.raw, core.KEYS), f"SELECT {K}, count(*) AS n_rows FROM raw GROUP BY {K} HAVING count(*) > 1")
add("duplicate_summary", lambda t: A.duplicate_summary(t.raw, core.KEYS), f"SELECT source, count(*) AS duplicate_keys, sum(n)::BIGINT AS duplicate_rows, max(n) AS largest FROM (SELECT source, count(*) AS n FROM raw GROUP BY source, {K} HAVING count(*) > 1) GROUP BY 1")
add("slot_range", lambda t: A.slot_range(t.raw), "SELECT min(interval_index) AS min_slot, max(interval_index) AS max_slot, count(*) FILTER (interval_index IS NULL OR interval_index NOT BETWEEN 0 AND 95) AS bad_rows FROM raw")
add("time_bin_coverage", lambda t: t.obs.groupBy("time_bin").agg(F.count("*").alias("n_rows")), "SELECT time_bin, count(*) AS n_rows FROM obs GROUP BY 1")
add("volume_distribution", lambda t: A.volume_distribution(t.raw_days), "SELECT min(volume_15m) AS min_volume, max(volume_15m) AS max_volume, count(*) FILTER (volume_15m < 0) AS negative_rows, count(*) FILTER (volume_15m = 0) AS zero_rows, count(*) FILTER (volume_15m > 0) AS positive_rows, count(*) FILTER (volume_15m IS NULL) AS null_rows FROM raw_days")
_SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98, 0.999, 1.0]
add(
    "volume_quantiles",
    lambda t: t.spark.createDataFrame(list(zip(_SHARES, O.quantiles(t.raw_days, "volume_15m", _SHARES), strict=True)), "share double, volume double"),
    "SELECT unnest([" + ", ".join(f"{q}::DOUBLE" for q in _SHARES) + "]) AS share, unnest([" + ", ".join(f"quantile_cont(volume_15m, {q})::DOUBLE" for q in _SHARES) + "]) AS volume FROM raw_days",
)
add("negative_values", lambda t: core.top(A.negatives_by(t.raw_days, "volume_15m"), 20, "negative_rows", "volume_15m"), "SELECT volume_15m, count(*) AS negative_rows, row_number() OVER (ORDER BY count(*) DESC, volume_15m)::INTEGER AS rank FROM raw_days WHERE volume_15m < 0 GROUP BY 1 QUALIFY rank <= 20")
for name, asc in (("daily_row_counts", True), ("daily_row_counts_high", False)):
    add(
        name,
        lambda t, asc=asc: core.top(t.raw_days.groupBy("count_date").agg(F.count("*").alias("n_rows"), F.count_if(F.col("volume_15m") < 0).alias("negative_rows")), 30, "n_rows", "count_date", asc=asc),
        f"SELECT count_date, count(*) AS n_rows, count(*) FILTER (volume_15m < 0) AS negative_rows, row_number() OVER (ORDER BY count(*) {'ASC' if asc else 'DESC'}, count_date)::INTEGER AS rank FROM raw_days GROUP BY 1 QUALIFY rank <= 30",
    )
for key in ("count_date", "site_id", "source_file_id"):
    add(f"negatives_by_{key}", lambda t, key=key: core.top(A.negatives_by(t.raw, key), 50, "negative_rows", key), f"SELECT {key}, count(*) AS negative_rows, row_number() OVER (ORDER BY count(*) DESC, {key})::INTEGER AS rank FROM raw WHERE volume_15m < 0 GROUP BY 1 QUALIFY rank <= 50")
_RVC = "sum(volume_15m)::BIGINT AS raw_volume, sum(volume_15m) FILTER (volume_15m >= 0)::BIGINT AS clean_volume, count(*) FILTER (volume_15m < 0) AS negative_rows FROM raw_days"
add("raw_vs_clean", lambda t: A.raw_vs_clean(t.raw_days), f"SELECT *, clean_volume - raw_volume AS gap FROM (SELECT {_RVC})")
add("raw_vs_clean_by_site", lambda t: A.raw_vs_clean(t.raw_days, "site_id"), f"SELECT *, clean_volume - raw_volume AS gap FROM (SELECT site_id, {_RVC} GROUP BY 1)")
add("raw_vs_clean_by_day", lambda t: core.top(A.raw_vs_clean(t.raw_days, "count_date"), 10, "gap", "count_date"), f"SELECT *, clean_volume - raw_volume AS gap, row_number() OVER (ORDER BY clean_volume - raw_volume DESC, count_date)::INTEGER AS rank FROM (SELECT count_date, {_RVC} GROUP BY 1) QUALIFY rank <= 10")
_HOLES = ", p AS (SELECT * FROM raw)"
_CALD = ", cal AS (SELECT unnest(generate_series(min(count_date), max(count_date), INTERVAL 1 DAY))::DATE AS count_date FROM p)"
add("missing_dates", lambda t: A.missing_dates(t.raw), _HOLES + _CALD + " SELECT count_date FROM cal WHERE count_date NOT IN (SELECT count_date FROM p)")
add("file_usage", lambda t: core.top(A.file_usage(t.raw), 50, "n_rows", "source_file_id"), "SELECT source_file_id, count(*) AS n_rows, min(count_date) AS first_date, max(count_date) AS last_date, count(DISTINCT site_id) AS sites, row_number() OVER (ORDER BY count(*) DESC, source_file_id)::INTEGER AS rank FROM raw GROUP BY 1 QUALIFY rank <= 50")
add("bad_daily_totals", lambda t: t.raw_days.groupBy("site_id", "count_date", "detector_id").agg(F.sum("volume_15m").alias("v")).agg(F.count_if(F.col("v") < 0).alias("bad_days")), "SELECT count(*) AS bad_days FROM (SELECT sum(volume_15m) AS v FROM raw_days GROUP BY site_id, count_date, detector_id) WHERE v < 0")
add("audit_verdict", lambda t: A.audit_verdict(t.raw, core.KEYS), _HOLES + _CALD + f" SELECT *, value = 0 AS ok FROM (SELECT 'bad_slots' AS check_name, count(*) FILTER (interval_index NOT BETWEEN 0 AND 95) AS value FROM p UNION ALL SELECT 'negative_rows', count(*) FILTER (volume_15m < 0) FROM p UNION ALL SELECT 'missing_dates', count(*) FROM cal WHERE count_date NOT IN (SELECT count_date FROM p) UNION ALL SELECT 'duplicate_excess', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM p GROUP BY {K}))")
_COV = "count(*) AS n_rows, count(DISTINCT count_date) AS dates, count(DISTINCT strftime(count_date, '%Y-%m')) AS months, count(DISTINCT site_id) AS sites, count(DISTINCT (site_id, detector_id)) AS detectors, sum(volume_15m)::BIGINT AS total_volume"
add("source_contribution", lambda t: A.coverage_by(t.raw, "source"), f"SELECT source, {_COV} FROM raw GROUP BY 1")
add("coverage_by_month", lambda t: A.coverage_by(t.raw.withColumn("month_label", C.month_label(F.col("count_date"))), "source", "month_label"), f"SELECT source, strftime(count_date, '%Y-%m') AS month_label, {_COV} FROM raw GROUP BY 1, 2")
add("coverage_by_year", lambda t: A.coverage_by(t.raw.withColumn("year", F.year("count_date")), "year"), f"SELECT year(count_date)::INTEGER AS year, {_COV} FROM raw GROUP BY 1")
add("coverage_by_region", lambda t: A.coverage_by(t.raw.join(t.sites.select("site_id", "region_code"), "site_id"), "region_code"), f"SELECT region_code, {_COV} FROM raw JOIN sites USING (site_id) GROUP BY 1")
_LEVELS = {"month": "strftime(count_date, '%Y-%m')", "year": "year(count_date)::VARCHAR", "region": "region_code", "source": "source", "all": "'all'"}


def coverage_levels(t):  # noqa: ANN001, ANN201
    """Coverage by month, year, region, source and overall, from states by month, region and source."""
    facts = t.raw.join(t.sites.select("site_id", "region_code"), "site_id").withColumn("month_label", C.month_label(F.col("count_date")))
    state = A.coverage_state(facts, "source", "month_label", "region_code")
    return A.merge_coverage(state, {"month": F.col("month_label"), "year": F.substring("month_label", 1, 4), "region": F.col("region_code"), "source": F.col("source"), "all": F.lit("all")})


add(
    "coverage_levels",
    coverage_levels,
    ", rr AS (SELECT raw.*, region_code FROM raw JOIN sites USING (site_id)) "
    + " UNION ALL ".join(f"SELECT '{n}' AS level, {k} AS key, count(*) AS n_rows, count(DISTINCT count_date) AS dates, count(DISTINCT site_id) AS sites, count(DISTINCT (site_id, detector_id)) AS detectors, sum(volume_15m)::BIGINT AS total_volume FROM rr GROUP BY 2" for n, k in _LEVELS.items()),
)
_SLOTS = _WIDE + ", dd AS (SELECT source, count(DISTINCT (site_id, count_date, detector_id)) AS n FROM raw GROUP BY 1), q AS (SELECT source, interval_index, count(v) AS c, count(*) FILTER (v < 0) AS neg, count(*) FILTER (v IN (-1, -2, -3, -4, -5, -9, -99, -999)) AS sen FROM w GROUP BY 1, 2), f AS (SELECT dd.source, s::INTEGER AS interval_index, n AS detector_days, n - coalesce(c, 0) AS null_count, coalesce(neg, 0) AS negative_count, coalesce(sen, 0) AS sentinel_count FROM dd CROSS JOIN range(0, 96) r(s) LEFT JOIN q ON q.source = dd.source AND q.interval_index = s)"
_TB = "printf('%02d:%02d', interval_index // 4, interval_index % 4 * 15) AS time_bin, (detector_days - null_count)::DOUBLE * 100 / detector_days AS coverage_pct"
add("slot_quality", lambda t: A.slot_quality(t.stored, "source"), _SLOTS + f" SELECT *, {_TB} FROM f")
add("slot_coverage", lambda t: A.slot_quality(t.stored).select("interval_index", "detector_days", "null_count", "coverage_pct"), _SLOTS + " SELECT interval_index, sum(detector_days)::BIGINT AS detector_days, sum(null_count)::BIGINT AS null_count, (sum(detector_days) - sum(null_count))::DOUBLE * 100 / sum(detector_days) AS coverage_pct FROM f GROUP BY 1")
add(
    "monthly_quality",
    lambda t: _r6(A.monthly_quality(t.raw), "rows_zscore"),
    ", x AS (SELECT strftime(count_date, '%Y-%m') AS month_label, count(*) AS n_rows, count(DISTINCT count_date) AS days_present, count(DISTINCT site_id) AS distinct_sites, sum(volume_15m)::BIGINT AS total_volume, avg(volume_15m) AS mean_volume, min(volume_15m) AS min_volume, max(volume_15m) AS max_volume FROM raw GROUP BY 1), "
    "z AS (SELECT *, coalesce((n_rows - avg(n_rows) OVER ()) / nullif(stddev_samp(n_rows) OVER (), 0), 0) AS z FROM x) SELECT * EXCLUDE (z), round(z, 6) AS rows_zscore, z < -2 AS low_row_count, z > 2 AS high_row_count FROM z",
)
add("detector_stability", lambda t: A.detector_stability(t.raw), ", d AS (SELECT count(DISTINCT count_date) AS d FROM raw GROUP BY site_id, detector_id) SELECT count(*) AS detectors, avg(d) AS mean_days, median(d)::DOUBLE AS median_days, max(d) AS max_days, min(d) AS min_days FROM d")
_MA = (
    ", k AS (SELECT unnest(generate_series(date_trunc('month', min(count_date)), date_trunc('month', max(count_date)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS m FROM raw), "
    "s AS (SELECT strftime(count_date, '%Y-%m') AS l, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n, count(*) AS n_rows, sum(volume_15m)::BIGINT AS total_volume FROM raw GROUP BY 1), "
    "ma AS (SELECT strftime(m, '%Y-%m') AS month_label, year(m)::INTEGER AS year, coalesce(sources, '') AS sources, coalesce(n, 0) AS source_count, n_rows, total_volume, n IS NOT NULL AS detected, strftime(m, '%Y-%m') IN ('1996-05', '2001-12') AS known_unavailable, "
    "CASE WHEN strftime(m, '%Y-%m') = '2001-11' AND n > 0 THEN 'Detected partial final month' WHEN strftime(m, '%Y-%m') IN ('1996-05', '2001-12') THEN 'Known unavailable' WHEN n > 0 THEN 'Detected' ELSE 'Missing' END AS status FROM k LEFT JOIN s ON l = strftime(m, '%Y-%m'))"
)
months = lambda t: A.month_audit(t.raw, core.month_calendar(t.raw, extra=1), ["1996-05", "2001-12"], "2001-11")
add("month_audit", months, _MA + " SELECT * FROM ma")
_YA = "count(*) AS expected_months, count(*) FILTER (detected) AS detected_months, count(*) FILTER (known_unavailable) AS known_unavailable_months, sum(n_rows)::BIGINT AS n_rows, sum(total_volume)::BIGINT AS total_volume"
add("year_audit", lambda t: A.year_audit(months(t), 2001), _MA + f", y AS (SELECT year, {_YA} FROM ma GROUP BY 1) SELECT *, detected_months - known_unavailable_months AS valid_months_detected, expected_months - detected_months - known_unavailable_months AS missing_unexplained_months, year = 2001 AS is_partial_year FROM y")
add("unified_summary", lambda t: A.unified_summary(t.raw_days), "SELECT strftime(count_date, '%Y-%m') AS month_label, count(*) AS n_rows, count(*) FILTER (volume_15m IS NULL) AS null_rows, count(*) FILTER (volume_15m < 0) AS negative_rows, count(DISTINCT count_date) AS dates FROM raw_days GROUP BY 1")
