"""Queries: rankings, limits, top-k, and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core
from slotwise.operators import ordered as O
from slotwise.operators import profiles as P
from slotwise.operators import sites as S
from slotwise.plans.base import add
from slotwise.plans.profiles import DOW, MOY, YEAR, _r6, bins

rk = lambda t: O.ranked(t.site_totals, "total_volume", "site_id")

_NAMED = "SELECT site_id, total_volume, row_number() OVER (ORDER BY total_volume {0}, site_id)::INTEGER AS rank, coalesce(site_name, site_id::VARCHAR) AS site_name FROM st LEFT JOIN sites USING (site_id) QUALIFY rank <= 50"
for name, asc in (("top_sites", False), ("bottom_sites", True)):
    add(name, lambda t, asc=asc: S.with_site_name(core.top(t.site_totals, 50, "total_volume", "site_id", asc=asc), S.site_names(t.sites)), _NAMED.format("ASC" if asc else "DESC"))
for name, asc in (("top_days", False), ("quietest_days", True)):
    add(name, lambda t, asc=asc: core.top(t.daily, 20, "day_total_volume", "count_date", asc=asc), f"SELECT *, row_number() OVER (ORDER BY day_total_volume {'ASC' if asc else 'DESC'}, count_date)::INTEGER AS rank FROM daily QUALIFY rank <= 20")
for name, asc in (("busiest_time_bins", False), ("quietest_time_bins", True)):
    add(name, lambda t, asc=asc: core.top(bins(t).select("time_bin", "total_volume"), 20, "total_volume", "time_bin", asc=asc), f"SELECT time_bin, total_volume, row_number() OVER (ORDER BY total_volume {'ASC' if asc else 'DESC'}, time_bin)::INTEGER AS rank FROM bins QUALIFY rank <= 20")
for name, make, table, tie in (("best_day", lambda t: t.daily, "daily", "count_date"), ("best_site", lambda t: t.site_totals, "st", "site_id"), ("best_time_bin", bins, "bins", "time_bin"), ("best_dow", lambda t: core.profile(t.day_bins, **DOW()), "dow", "iso_dow"), ("best_month_of_year", lambda t: core.profile(t.day_bins, **MOY()), "moy", "month_of_year"), ("best_year", lambda t: core.profile(t.day_bins, **YEAR()), "yearly", "year")):
    metric = {"daily": "day_total_volume", "st": "total_volume"}.get(table, "avg_daily_volume")
    add(name, lambda t, make=make, metric=metric, tie=tie: core.best(make(t), metric, tie), f"SELECT * FROM {table} ORDER BY {metric} DESC, {tie} LIMIT 1")
for name, asc in (("site_peak_slot", False), ("site_quiet_slot", True)):
    add(name, lambda t, asc=asc: S.site_peak_slot(t.obs, asc), f", x AS (SELECT site_id, time_bin, avg(volume_15m) AS avg_volume FROM obs GROUP BY 1, 2) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY avg_volume {'ASC' if asc else 'DESC'}, time_bin) = 1")
for name, make, table, tie, n in (("rank_time_bins", bins, "bins", "time_bin", 10), ("rank_months", lambda t: core.profile(t.day_bins, **MOY()), "moy", "month_of_year", 12), ("rank_years", lambda t: core.profile(t.day_bins, **YEAR()), "yearly", "year", 10)):
    add(name, lambda t, make=make, tie=tie, n=n: core.top(make(t), n, "avg_daily_volume", tie), f"SELECT *, row_number() OVER (ORDER BY avg_daily_volume DESC, {tie})::INTEGER AS rank FROM {table} QUALIFY rank <= {n}")
_G = ", gy AS (SELECT site_id, year(count_date)::INTEGER AS y, sum(volume_15m)::BIGINT AS v FROM obs GROUP BY 1, 2), g AS (SELECT site_id, min(y) AS first_year, arg_min(v, y) AS first_year_volume, max(y) AS last_year, arg_max(v, y) AS last_year_volume FROM gy GROUP BY 1 HAVING min(y) < max(y)), growth AS (SELECT *, last_year_volume - first_year_volume AS absolute_change, round((last_year_volume - first_year_volume)::DOUBLE * 100 / nullif(first_year_volume, 0), 2) AS pct_change FROM g)"
add("growth_by_year", lambda t: S.growth_by_year(t.site_days), _G + " SELECT * FROM growth")
for name, asc in (("rank_growth", False), ("rank_decline", True)):
    add(name, lambda t, asc=asc: core.top(S.growth_by_year(t.site_days).filter("pct_change is not null"), 20, "pct_change", "site_id", asc=asc), _G + f" SELECT *, row_number() OVER (ORDER BY pct_change {'ASC' if asc else 'DESC'}, site_id)::INTEGER AS rank FROM growth WHERE pct_change IS NOT NULL QUALIFY rank <= 20")
_RANKED = ", b AS (SELECT site_id, count(*) AS months_present, min(month_label) AS first_month, max(month_label) AS last_month, avg(month_site_volume) AS avg_monthly_volume, max(month_site_volume) AS max_monthly_volume, arg_max(month_label, (month_site_volume, -replace(month_label, '-', '')::INTEGER)) AS best_month FROM sm GROUP BY 1), ranked AS (SELECT rk.site_id, total_volume, months_present, first_month, last_month, avg_monthly_volume, max_monthly_volume, best_month, rank, cumulative_volume, total_volume::DOUBLE * 100 / network_volume AS percent_of_network, cumulative_volume::DOUBLE * 100 / network_volume AS cumulative_percent, CASE WHEN rank / sites::DOUBLE <= 0.01 THEN 'Top 1%' WHEN rank / sites::DOUBLE <= 0.05 THEN 'Top 5%' WHEN rank / sites::DOUBLE <= 0.1 THEN 'Top 10%' WHEN rank / sites::DOUBLE <= 0.25 THEN 'Top 25%' WHEN rank / sites::DOUBLE <= 0.5 THEN 'Top 50%' ELSE 'Bottom 50%' END AS percentile_band FROM rk JOIN b USING (site_id))"
add("site_rankings", lambda t: S.site_rankings(t.sm), _RANKED + " SELECT * FROM ranked")
add("percentile_bands", lambda t: S.site_rankings(t.sm).groupBy("percentile_band").agg(F.count("*").alias("sites"), F.sum("total_volume").alias("total_volume")), _RANKED + " SELECT percentile_band, count(*) AS sites, sum(total_volume)::BIGINT AS total_volume FROM ranked GROUP BY 1")
add("top_n_slices", lambda t: S.portfolio_simulation(rk(t), [10, 25, 50, 100]).select("portfolio_size", "sites", "captured_volume"), ", n(portfolio_size) AS (VALUES (10), (25), (50), (100)) SELECT portfolio_size, count(*) AS sites, sum(total_volume)::BIGINT AS captured_volume FROM n JOIN rk ON rank <= portfolio_size GROUP BY 1")
add("busiest_day_by_year", lambda t: core.top_per_group(t.daily.withColumn("year", F.year("count_date")), "year", "day_total_volume", "count_date"), "SELECT *, year(count_date)::INTEGER AS year FROM daily QUALIFY row_number() OVER (PARTITION BY year(count_date) ORDER BY day_total_volume DESC, count_date) = 1")
add("top_days_named", lambda t: core.top(t.daily.withColumn("day_name", F.date_format("count_date", "EEEE")), 50, "day_total_volume", "count_date"), "SELECT *, dayname(count_date) AS day_name, row_number() OVER (ORDER BY day_total_volume DESC, count_date)::INTEGER AS rank FROM daily QUALIFY rank <= 50")
add(
    "monthly_peak_drift",
    lambda t: core.top_per_group(P.time_bin_profile(t.day_bins), "month_label", "total_volume", "time_bin").crossJoin(F.broadcast(core.best(bins(t), "avg_daily_volume", "time_bin").select(F.col("time_bin").alias("archive_peak")))).select("month_label", "time_bin", "total_volume", (F.col("time_bin") != F.col("archive_peak")).alias("drifted")),
    ", x AS (SELECT strftime(count_date, '%Y-%m') AS month_label, time_bin, sum(volume_15m)::BIGINT AS total_volume FROM obs GROUP BY 1, 2) SELECT *, time_bin <> (SELECT time_bin FROM bins ORDER BY avg_daily_volume DESC, time_bin LIMIT 1) AS drifted FROM x QUALIFY row_number() OVER (PARTITION BY month_label ORDER BY total_volume DESC, time_bin) = 1",
)
add("largest_changes", lambda t: core.top(t.daily.withColumn("change", F.col("day_total_volume") - F.lag("day_total_volume").over(Window.orderBy("count_date"))).withColumn("abs_change", F.abs("change")).filter("change is not null"), 30, "abs_change", "count_date"), ", x AS (SELECT *, day_total_volume - lag(day_total_volume) OVER (ORDER BY count_date) AS change FROM daily) SELECT *, abs(change) AS abs_change, row_number() OVER (ORDER BY abs(change) DESC, count_date)::INTEGER AS rank FROM x WHERE change IS NOT NULL QUALIFY rank <= 30")
add("monthly_site_rank", lambda t: S.monthly_site_rank(t.sm), "SELECT *, rank() OVER (PARTITION BY month_label ORDER BY month_site_volume DESC)::INTEGER AS month_rank, count(*) OVER (PARTITION BY month_label) AS sites_in_month FROM sm")
add(
    "peak_cluster",
    lambda t: core.top(bins(t), 10, "total_volume", "time_bin").withColumn("m", C.time_bin_to_minutes(F.col("time_bin"))).agg(F.min("time_bin").alias("first_bin"), F.max("time_bin").alias("last_bin"), ((F.max("m") - F.min("m")) / F.lit(60.0)).alias("span_hours")),
    ", x AS (SELECT time_bin, time_bin[1:2]::INTEGER * 60 + time_bin[4:5]::INTEGER AS m FROM bins ORDER BY total_volume DESC, time_bin LIMIT 10) SELECT min(time_bin) AS first_bin, max(time_bin) AS last_bin, (max(m) - min(m)) / 6e1 AS span_hours FROM x",
)
add("rank_volatile", lambda t: core.top(_r6(P.variability(t.sm, "site_id", "month_site_volume", 12), "cv").select("site_id", "cv"), 20, "cv", "site_id"), ", x AS (SELECT site_id, round(stddev_samp(month_site_volume) / avg(month_site_volume), 6) AS cv FROM sm GROUP BY 1 HAVING count(*) >= 12) SELECT *, row_number() OVER (ORDER BY cv DESC, site_id)::INTEGER AS rank FROM x QUALIFY rank <= 20")
for name, asc in (("rank_variable", False), ("rank_predictable", True)):
    add(
        name,
        lambda t, asc=asc: core.top(P.daily_variability(t.site_days).withColumn("sd_daily_volume", F.round("sd_daily_volume", 6)), 100, "cv", "site_id", asc=asc),
        ", d AS (SELECT site_id, count_date, sum(volume_15m)::BIGINT AS v FROM obs GROUP BY 1, 2), x AS (SELECT site_id, avg(v) AS mean_daily_volume, round(stddev_samp(v), 6) AS sd_daily_volume, CASE WHEN avg(v) > 0 THEN round(stddev_samp(v) / avg(v), 4) END AS cv FROM d GROUP BY 1 HAVING count(*) >= 100) "
        f"SELECT *, row_number() OVER (ORDER BY cv {'ASC' if asc else 'DESC'} NULLS LAST, site_id)::INTEGER AS rank FROM x QUALIFY rank <= 100",
    )
add("semi_top", lambda t: core.semi_top(t.obs, 10).agg(F.count("*").alias("n_rows"), F.sum("volume_15m").alias("v")), "SELECT count(*) AS n_rows, sum(volume_15m)::BIGINT AS v FROM obs WHERE site_id IN (SELECT site_id FROM st ORDER BY total_volume DESC, site_id LIMIT 10)")
add("with_coordinates", lambda t: core.top(t.site_totals, 100, "total_volume", "site_id").join(t.sites, "site_id", "left").select("rank", "site_id", "total_volume", "site_name", "latitude", "longitude"), "SELECT rank, site_id, total_volume, site_name, latitude, longitude FROM rk LEFT JOIN sites USING (site_id) WHERE rank <= 100")
add("missing_coordinates", lambda t: t.site_totals.join(t.sites, "site_id", "left").agg(F.count("*").alias("sites"), F.count_if(F.col("latitude").isNull()).alias("missing")), "SELECT count(*) AS sites, count(*) FILTER (latitude IS NULL) AS missing FROM st LEFT JOIN sites USING (site_id)")
add("orphan_sites", lambda t: S.orphans(t.raw, S.valid_coordinates(t.sites), "site_id"), "SELECT site_id, count(*) AS n_rows FROM raw WHERE site_id NOT IN (SELECT site_id FROM sites WHERE latitude BETWEEN -39.5 AND -36 AND longitude BETWEEN 143 AND 147.5) GROUP BY 1")
add("orphan_files", lambda t: S.orphans(t.raw, t.read("orders").select(F.col("o_orderkey").alias("source_file_id")), "source_file_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")), "SELECT count(DISTINCT source_file_id) AS files, count(*) AS n_rows FROM raw WHERE source_file_id NOT IN (SELECT o_orderkey FROM orders)")
_TWO = "SELECT site_id, site_name, latitude, longitude, 2 AS o FROM sites UNION ALL SELECT site_id, CASE WHEN site_id % 2 = 0 THEN municipality || ' ' || site_name ELSE 'x' END, -37::DOUBLE, CASE WHEN site_id % 3 <> 0 THEN 144.5::DOUBLE END, 1 FROM sites"


def two_lookups(t):  # noqa: ANN001, ANN201
    """The sites, and a second lookup with longer names for some sites and without a place for others."""
    own = t.sites.select("site_id", "site_name", "latitude", "longitude", F.lit(2).alias("lookup_order"))
    name = F.when(F.col("site_id") % 2 == 0, F.concat_ws(" ", "municipality", "site_name")).otherwise("x")
    other = t.sites.select("site_id", name.alias("site_name"), F.lit(-37.0).alias("latitude"), F.when(F.col("site_id") % 3 != 0, 144.5).alias("longitude"), F.lit(1).alias("lookup_order"))
    return own.unionByName(other)


add("best_site_lookup", lambda t: S.best_site_lookup(two_lookups(t)), f", lk AS ({_TWO}) SELECT site_id, site_name, latitude, longitude FROM lk WHERE latitude BETWEEN -40 AND -33 AND longitude BETWEEN 140 AND 150 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY length(site_name) DESC, o, site_name) = 1")
_H = "2 * 6371000 * asin(sqrt(least(1, pow(sin((radians(p.latitude) - radians(f.latitude)) / 2), 2) + cos(radians(p.latitude)) * cos(radians(f.latitude)) * pow(sin((radians(p.longitude) - radians(f.longitude)) / 2), 2))))"
add("nearest_within", lambda t: _r6(S.nearest_within(t.sites, t.features, 3000.0), "metres"), f", f AS (SELECT c_custkey AS feature_id, -37.8::DOUBLE + (c_custkey % 997 - 498) / 2e3 AS latitude, 145::DOUBLE + (c_custkey % 991 - 495) / 2e3 AS longitude FROM customer), d AS (SELECT p.site_id, f.feature_id, {_H} AS m FROM sites p, f) SELECT site_id, feature_id, round(m, 6) AS metres FROM d WHERE m <= 3000 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY m, feature_id) = 1")
