"""Queries: reshape, clean, dedup, totals and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core
from slotwise.operators import profiles as P
from slotwise.plans.base import add

DATE = "count_date"


def DOW():  # noqa: ANN201, N802
    return {"iso_dow": C.iso_dow(DATE)}


def MOY():  # noqa: ANN201, N802
    return {"month_of_year": F.month(DATE)}


def YEAR():  # noqa: ANN201, N802
    return {"year": F.year(DATE)}


def bins(t):  # noqa: ANN001, ANN201
    return core.profile(t.day_bins, time_bin=F.col("time_bin"))


add("dedup_observations_file", lambda t: t.obs.select("site_id", "count_date", "detector_id", "interval_index", "volume_15m", "source_file_id"), "SELECT site_id, count_date, detector_id, interval_index, volume_15m, source_file_id FROM obs")
add("dedup_observations_priority", lambda t: t.obs_days.select("site_id", "count_date", "detector_id", "interval_index", "time_bin", "volume_15m", "source_file_id"), "SELECT site_id, count_date, detector_id, interval_index, time_bin, volume_15m, source_file_id FROM obs_days")
add("clean_modes", lambda t: core.clean(t.raw_days, "filter").groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("volume_15m").alias("v")).withColumn("mode", F.lit("filter")).unionByName(core.clean(t.raw_days, "nullify").groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("volume_15m").alias("v")).withColumn("mode", F.lit("nullify"))),
    "SELECT source, count(*) AS n_rows, sum(volume_15m)::BIGINT AS v, 'filter' AS mode FROM raw_days WHERE volume_15m >= 0 GROUP BY 1 UNION ALL SELECT source, count(*), sum(CASE WHEN volume_15m >= 0 THEN volume_15m END)::BIGINT, 'nullify' FROM raw_days GROUP BY 1")
add("first_valid_policy", lambda t: core.dedup_observations(core.clean(t.raw_days, "filter"), "priority").agg(F.count("*").alias("n_rows"), F.sum("volume_15m").alias("v")),
    "SELECT count(*) AS n_rows, sum(volume_15m)::BIGINT AS v FROM (SELECT * FROM raw_days WHERE volume_15m >= 0 QUALIFY row_number() OVER (PARTITION BY site_id, count_date, detector_id, interval_index ORDER BY source_priority, source_file_id) = 1)")
_WIDE = """, w AS (SELECT source, source_priority, site_id, count_date, detector_id, interval_index, sum(volume_15m)::INTEGER AS v, min(source_file_id) AS f FROM raw GROUP BY ALL)
"""
add("to_long", lambda t: core.to_long(t.wide).filter("volume_15m is not null").select("source", "site_id", "count_date", "detector_id", "interval_index", "time_bin", "volume_15m"), _WIDE + "SELECT source, site_id, count_date, detector_id, interval_index, printf('%02d:%02d', interval_index // 4, interval_index % 4 * 15) AS time_bin, v AS volume_15m FROM w")
add("dedup_detector_days", lambda t: core.dedup_detector_days(t.wide).select("site_id", "count_date", "detector_id", "source", "source_file_id", core.slots_total(F.col("slots")).alias("day_volume")),
    _WIDE + "SELECT site_id, count_date, detector_id, source, f AS source_file_id, v AS day_volume FROM (SELECT site_id, count_date, detector_id, source, source_priority, min(f) AS f, coalesce(sum(v) FILTER (v >= 0), 0)::BIGINT AS v FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY site_id, count_date, detector_id ORDER BY source_priority, f) = 1")
add("merge_slots", lambda t: core.merge_slots(t.wide, tasks=t.obs_tasks).select("site_id", "count_date", "detector_id", core.slots_total(F.col("slots")).alias("day_volume")),
    _WIDE + "SELECT site_id, count_date, detector_id, coalesce(sum(v) FILTER (v >= 0), 0)::BIGINT AS day_volume FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY site_id, count_date, detector_id, interval_index ORDER BY v < 0, source_priority) = 1) GROUP BY ALL")
add("require_keys_between_dates", lambda t: core.between_dates(core.require_keys(t.raw_days), "2024-01-10", "2024-01-12").groupBy("count_date").agg(F.count("*").alias("n_rows")), "SELECT count_date, count(*) AS n_rows FROM raw_days WHERE count_date >= DATE '2024-01-10' AND count_date < DATE '2024-01-12' GROUP BY 1")
add("date_range", lambda t: t.raw.agg(F.min("count_date").alias("first_date"), F.max("count_date").alias("last_date")), "SELECT min(count_date) AS first_date, max(count_date) AS last_date FROM raw")
add("total_volume", lambda t: t.site_days.agg(F.sum("volume_15m").alias("total_volume")), "SELECT sum(volume_15m)::BIGINT AS total_volume FROM obs")
add("dataset_summary", lambda t: P.dataset_summary(t.site_days), "SELECT count(*) AS row_count, count(DISTINCT site_id) AS distinct_sites, min(count_date) AS min_date, max(count_date) AS max_date, sum(volume_15m)::BIGINT AS total_volume FROM obs")
add("daily_totals", lambda t: t.daily, "SELECT * FROM daily")
add("monthly_totals", lambda t: core.monthly_totals(t.day_bins, core.month_calendar(t.day_bins, extra=1)),
    ", cal AS (SELECT unnest(generate_series(date_trunc('month', min(count_date)), date_trunc('month', max(count_date)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS m FROM obs) SELECT strftime(m, '%Y-%m') AS month_label, m AS month_start, (m + INTERVAL 1 MONTH)::DATE AS next_month_start, coalesce(month_total_volume, 0)::BIGINT AS month_total_volume, CASE WHEN month_total_volume IS NULL THEN 'zero_row_month' ELSE 'data' END AS row_type FROM cal LEFT JOIN monthly ON month_label = strftime(m, '%Y-%m')")
add("site_totals", lambda t: t.site_totals, "SELECT * FROM st")
add("site_month_totals", lambda t: t.sm, "SELECT * FROM sm")
add("site_detector_totals", lambda t: t.obs.groupBy("site_id", "detector_id").agg(F.sum("volume_15m").alias("total_volume")), "SELECT site_id, detector_id, sum(volume_15m)::BIGINT AS total_volume FROM obs GROUP BY 1, 2")
add("time_bin_totals", lambda t: t.day_bins.groupBy("time_bin").agg(F.sum("volume_15m").alias("total_volume")), "SELECT time_bin, total_volume FROM bins")
add("time_bin_profile", lambda t: P.time_bin_profile(t.day_bins), "SELECT strftime(count_date, '%Y-%m') AS month_label, time_bin, sum(volume_15m)::BIGINT AS total_volume, count(DISTINCT count_date) AS days_loaded, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS avg_daily_volume FROM obs GROUP BY 1, 2")
add("time_bin_extremes", lambda t: P.time_bin_extremes(bins(t)), "SELECT a.time_bin AS best_time_bin, a.avg_daily_volume AS best_avg, b.time_bin AS quietest_time_bin, b.avg_daily_volume AS quietest_avg FROM (SELECT * FROM bins ORDER BY avg_daily_volume DESC, time_bin LIMIT 1) a, (SELECT * FROM bins ORDER BY avg_daily_volume, time_bin LIMIT 1) b")
add("day_of_week_profile", lambda t: core.profile(t.day_bins, **DOW()).withColumn("day_name", C.day_name(F.col("iso_dow"))), "SELECT *, CASE iso_dow WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' ELSE 'Sunday' END AS day_name FROM dow")
add("month_of_year_profile", lambda t: core.profile(t.day_bins, **MOY()), "SELECT * FROM moy")
add("yearly_totals", lambda t: core.profile(t.day_bins, **YEAR()), "SELECT * FROM yearly")
_SPLIT = "coalesce(sum(day_total_volume) FILTER (isodow(count_date) < 6), 0)::BIGINT AS weekday_volume, coalesce(sum(day_total_volume) FILTER (isodow(count_date) >= 6), 0)::BIGINT AS weekend_volume, count(*) FILTER (isodow(count_date) < 6) AS weekday_days, count(*) FILTER (isodow(count_date) >= 6) AS weekend_days FROM daily"
add("weekday_weekend_split", lambda t: core.weekday_weekend(t.day_bins, C.month_label(DATE).alias("month_label")), f"SELECT strftime(count_date, '%Y-%m') AS month_label, {_SPLIT} GROUP BY 1")
add("weekday_vs_weekend", lambda t: P.weekday_vs_weekend(t.daily), "SELECT CASE WHEN isodow(count_date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS days, avg(day_total_volume) AS avg_daily_volume FROM daily GROUP BY 1")
add("weekday_weekend_rows", lambda t: P.split_rows(core.weekday_weekend(t.day_bins)), f", s AS (SELECT {_SPLIT}) SELECT 'weekday' AS day_type, weekday_volume AS volume, weekday_days AS days, weekday_volume / weekday_days::DOUBLE AS avg_daily_volume FROM s UNION ALL SELECT 'weekend', weekend_volume, weekend_days, weekend_volume / weekend_days::DOUBLE FROM s")
add("monday_vs_friday", lambda t: core.profile(t.day_bins, **DOW()).filter(F.col("iso_dow").isin(1, 5)), "SELECT * FROM dow WHERE iso_dow IN (1, 5)")
add("monday_friday_comparison", lambda t: P.monday_friday_comparison(core.profile(t.day_bins, **DOW())), ", x AS (SELECT max(avg_daily_volume) FILTER (iso_dow = 1) AS monday_avg, max(avg_daily_volume) FILTER (iso_dow = 5) AS friday_avg FROM dow) SELECT *, friday_avg - monday_avg AS difference, (friday_avg - monday_avg) * 100 / monday_avg AS pct_difference FROM x")
_PEAK = "sum(volume_15m)::BIGINT AS total_volume, coalesce(sum(volume_15m) FILTER (time_bin >= '07:00' AND time_bin < '10:00'), 0)::BIGINT AS am_volume, coalesce(sum(volume_15m) FILTER (time_bin >= '16:00' AND time_bin < '19:00'), 0)::BIGINT AS pm_volume FROM obs"
_SHARE = "am_volume::DOUBLE * 100 / nullif(total_volume, 0) AS am_share_pct, pm_volume::DOUBLE * 100 / nullif(total_volume, 0) AS pm_share_pct"
add("peak_shares", lambda t: core.peak_shares(t.day_bins, C.month_label(DATE).alias("month_label")), f", x AS (SELECT strftime(count_date, '%Y-%m') AS month_label, {_PEAK} GROUP BY 1) SELECT *, {_SHARE} FROM x")
add("peak_shares_overall", lambda t: core.peak_shares(t.day_bins), f", x AS (SELECT {_PEAK}) SELECT *, {_SHARE} FROM x")
add("day_part_shares", lambda t: core.day_part_shares(t.day_bins),
    ", x AS (SELECT sum(volume_15m)::BIGINT AS total_volume, " + ", ".join(f"coalesce(sum(volume_15m) FILTER ({c}), 0)::BIGINT AS {n}" for n, c in (("am_peak", "time_bin >= '07:00' AND time_bin < '10:00'"), ("pm_peak", "time_bin >= '16:00' AND time_bin < '19:00'"), ("overnight", "time_bin < '06:00'"), ("before_9am", "time_bin < '09:00'"), ("after_6pm", "time_bin >= '18:00'"))) + " FROM obs) SELECT *, " + ", ".join(f"round({n}::DOUBLE * 100 / total_volume, 2) AS {n}_pct" for n in ("am_peak", "pm_peak", "overnight", "before_9am", "after_6pm")) + " FROM x")
_PEAK_BEST = "(SELECT time_bin, v FROM tb WHERE {0} ORDER BY v DESC, time_bin LIMIT 1)"
add(
    "peak_hour_summary",
    lambda t: P.peak_hour_summary(P.time_bin_profile(t.day_bins)),
    ", mb AS (SELECT strftime(count_date, '%Y-%m') AS l, time_bin, sum(volume_15m)::BIGINT AS v, count(DISTINCT count_date) AS d FROM obs GROUP BY 1, 2), tb AS (SELECT time_bin, sum(v)::BIGINT AS v FROM mb GROUP BY 1), "
    "td AS (SELECT sum(d)::DOUBLE AS d FROM (SELECT l, max(d) AS d FROM mb GROUP BY 1)) SELECT a.time_bin AS peak_time_bin, a.v AS peak_volume, a.v / d AS peak_avg, b.time_bin AS am_peak_time_bin, b.v AS am_peak_volume, b.v / d AS am_peak_avg, "
    "c.time_bin AS pm_peak_time_bin, c.v AS pm_peak_volume, c.v / d AS pm_peak_avg FROM td, "
    + f"{_PEAK_BEST.format('true')} a, " + _PEAK_BEST.format("time_bin >= '07:00' AND time_bin < '10:00'") + " b, " + _PEAK_BEST.format("time_bin >= '16:00' AND time_bin < '19:00'") + " c",
)
add("seasonal_table", lambda t: core.profile(t.day_bins, **MOY()).select("month_of_year", "avg_daily_volume", C.season(F.col("month_of_year")).alias("season")), "SELECT month_of_year, avg_daily_volume, CASE WHEN month_of_year IN (12, 1, 2) THEN 'summer' WHEN month_of_year <= 5 THEN 'autumn' WHEN month_of_year <= 8 THEN 'winter' ELSE 'spring' END AS season FROM moy")
add("year_table", lambda t: core.profile(t.day_bins, **YEAR()).select("year", "total_volume", "avg_daily_volume"), "SELECT year, total_volume, avg_daily_volume FROM yearly")
add("site_extreme_slots", lambda t: P.site_extreme_slots(t.obs), "SELECT site_id, max(volume_15m) AS max_slot_volume, min(volume_15m) FILTER (volume_15m > 0) AS min_nonzero_slot_volume FROM obs GROUP BY 1")
_TOP = ", top AS (SELECT site_id FROM st ORDER BY total_volume DESC, site_id LIMIT 5), o AS (SELECT * FROM obs WHERE site_id IN (SELECT site_id FROM top))"
add("top_site_daily", lambda t: P.site_daily(core.semi_top(t.site_days, 5)), _TOP + " SELECT site_id, count_date, sum(volume_15m)::BIGINT AS v FROM o GROUP BY 1, 2")
add("top_site_profile", lambda t: core.semi_top(t.obs, 5).groupBy("site_id", "time_bin").agg(F.sum("volume_15m").alias("total_volume"), F.avg("volume_15m").alias("avg_volume")), _TOP + " SELECT site_id, time_bin, sum(volume_15m)::BIGINT AS total_volume, avg(volume_15m) AS avg_volume FROM o GROUP BY 1, 2")
add("top_site_detectors", lambda t: core.top(core.semi_top(t.obs, 5).groupBy("site_id", "detector_id").agg(F.sum("volume_15m").alias("total_volume")).withColumn("tie", F.col("site_id") * 100 + F.col("detector_id")), 20, "total_volume", "tie").drop("tie"), _TOP + " SELECT site_id, detector_id, sum(volume_15m)::BIGINT AS total_volume, row_number() OVER (ORDER BY sum(volume_15m) DESC, site_id, detector_id)::INTEGER AS rank FROM o GROUP BY 1, 2 QUALIFY rank <= 20")
_VAR = "count({v}) AS n, avg({v}) AS mean, round(stddev_samp({v}), 6) AS sd, min({v}) AS min, max({v}) AS max, round(stddev_samp({v}) / avg({v}), 6) AS cv"
_r6 = lambda df, *names: df.withColumns({c: F.round(c, 6) for c in names})
add("site_daily_variability", lambda t: _r6(P.variability(P.site_daily(t.site_days), "site_id", "v", 100), "sd", "cv"), ", d AS (SELECT site_id, count_date, sum(volume_15m)::BIGINT AS v FROM obs GROUP BY 1, 2) SELECT site_id, " + _VAR.format(v="v") + " FROM d GROUP BY 1 HAVING count(*) >= 100")
add("site_month_variability", lambda t: _r6(P.variability(t.sm, "site_id", "month_site_volume", 12), "sd", "cv"), "SELECT site_id, " + _VAR.format(v="month_site_volume") + " FROM sm GROUP BY 1 HAVING count(*) >= 12")
add("network_trend", lambda t: P.network_stability(t.sm).select("month_label", "total_volume", "active_sites"), "SELECT month_label, sum(month_site_volume)::BIGINT AS total_volume, count(DISTINCT site_id) AS active_sites FROM sm GROUP BY 1")
add("network_stability", lambda t: _r6(P.network_stability(t.sm).select("month_label", "mean", "sd", "cv"), "sd", "cv"), "SELECT month_label, avg(month_site_volume) AS mean, round(stddev_samp(month_site_volume), 6) AS sd, round(stddev_samp(month_site_volume) / avg(month_site_volume), 6) AS cv FROM sm GROUP BY 1")
add("weekly_pulse", lambda t: P.weekly_pulse(t.obs_days.filter("volume_15m is not null")), "SELECT isodow(count_date)::INTEGER AS iso_dow, time_bin, sum(volume_15m)::BIGINT AS total_volume, count(*) AS n_rows, avg(volume_15m) AS mean_volume, row_number() OVER (ORDER BY sum(volume_15m) DESC, isodow(count_date), time_bin)::INTEGER AS rank FROM obs_days WHERE volume_15m IS NOT NULL GROUP BY isodow(count_date), time_bin")
add("distinct_sites", lambda t: t.raw.select("site_id").distinct().union(t.raw_days.select("site_id").distinct()).agg(F.countDistinct("site_id").alias("sites")), "SELECT count(*) AS sites FROM (SELECT site_id FROM raw UNION SELECT site_id FROM raw_days)")
add("headline_metrics", lambda t: P.headline_metrics(P.dataset_summary(t.site_days).select("total_volume", "distinct_sites"), core.best(t.daily, "day_total_volume", "count_date").select(F.col("count_date").alias("busiest_day")), core.best(t.site_totals, "total_volume", "site_id").select(F.col("site_id").alias("busiest_site"))),
    "SELECT (SELECT sum(volume_15m)::BIGINT FROM obs) AS total_volume, (SELECT count(DISTINCT site_id) FROM obs) AS distinct_sites, (SELECT count_date FROM daily ORDER BY day_total_volume DESC, count_date LIMIT 1) AS busiest_day, (SELECT site_id FROM st ORDER BY total_volume DESC, site_id LIMIT 1) AS busiest_site")
add("yearly_quantiles", lambda t: t.daily.groupBy(F.year("count_date").alias("year")).agg(F.percentile("day_total_volume", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q")).select("year", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))]),
    "SELECT year(count_date)::INTEGER AS year, " + ", ".join(f"round(quantile_cont(day_total_volume, {q})::DOUBLE, 6) AS {n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"))) + " FROM daily GROUP BY 1")
add("day_of_year_profile", lambda t: _r6(P.day_of_year_profile(t.daily), "avg_volume", "centred_mean"), ", d AS (SELECT dayofyear(count_date)::INTEGER AS day_of_year, avg(day_total_volume) AS v FROM daily GROUP BY 1) SELECT day_of_year, round(v, 6) AS avg_volume, round(CASE WHEN count(v) OVER f >= 3 THEN avg(v) OVER f END, 6) AS centred_mean FROM d WINDOW f AS (ORDER BY day_of_year ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)")
add("top_weeks", lambda t: P.top_weeks(t.daily), "SELECT printf('%d-W%02d', isoyear(count_date), week(count_date)) AS iso_week, sum(day_total_volume)::BIGINT AS week_volume, count(*) AS days, row_number() OVER (ORDER BY sum(day_total_volume) DESC, iso_week)::INTEGER AS rank FROM daily GROUP BY 1 QUALIFY rank <= 20")
add("weekday_average", lambda t: t.daily.groupBy(F.date_format("count_date", "EEEE").alias("day_name")).agg(F.avg("day_total_volume").alias("avg_volume")), "SELECT dayname(count_date) AS day_name, avg(day_total_volume) AS avg_volume FROM daily GROUP BY 1")
add("weekend_evolution", lambda t: P.matrix(t.daily.withColumn("weekend", (C.iso_dow(DATE) >= 6).cast("int")), F.year("count_date").alias("year"), "weekend", [0, 1], "day_total_volume", F.avg).select("year", F.col("0").alias("weekday_avg"), F.col("1").alias("weekend_avg")), "SELECT year(count_date)::INTEGER AS year, avg(day_total_volume) FILTER (isodow(count_date) < 6) AS weekday_avg, avg(day_total_volume) FILTER (isodow(count_date) >= 6) AS weekend_avg FROM daily GROUP BY 1")
add("month_seasonality", lambda t: t.monthly.groupBy(F.substring("month_label", 6, 2).cast("int").alias("month_of_year")).agg(F.avg("month_total_volume").alias("avg_month_volume")), "SELECT month_label[6:7]::INTEGER AS month_of_year, avg(month_total_volume) AS avg_month_volume FROM monthly GROUP BY 1")
add(
    "seasonal_index",
    lambda t: _r6(P.seasonal_index(core.profile(t.day_bins, month_label=C.month_label(DATE))), "avg_daily_volume", "median_daily_volume", "std_daily_volume", "seasonal_index"),
    ", m AS (SELECT strftime(count_date, '%Y-%m') AS l, sum(volume_15m)::BIGINT AS v, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS a FROM obs GROUP BY 1), x AS (SELECT l[6:7]::INTEGER AS month_of_year, avg(a) AS m, median(a) AS md, avg(v) AS avg_monthly_volume, "
    "sum(v)::BIGINT AS total_volume, stddev_samp(a) AS sd, count(DISTINCT l) AS months_seen, count(DISTINCT l[1:4]) AS years_seen FROM m GROUP BY 1) SELECT month_of_year, round(m, 6) AS avg_daily_volume, round(md, 6) AS median_daily_volume, avg_monthly_volume, total_volume, "
    "round(sd, 6) AS std_daily_volume, months_seen, years_seen, round(m * 100 / avg(m) OVER (), 6) AS seasonal_index FROM x",
)
add("month_share_of_year", lambda t: _r6(P.month_share_of_year(t.monthly), "avg_share_pct"), ", x AS (SELECT *, month_total_volume::DOUBLE * 100 / sum(month_total_volume) OVER (PARTITION BY month_label[1:4]) AS s FROM monthly) SELECT month_label[6:7]::INTEGER AS month_of_year, round(avg(s), 6) AS avg_share_pct FROM x GROUP BY 1")
add("day_segments", lambda t: P.day_segments(bins(t)), ", x AS (SELECT CASE WHEN time_bin < '05:00' THEN 'Overnight Quiet' WHEN time_bin < '10:00' THEN 'Morning Build' WHEN time_bin < '15:00' THEN 'Business-Day Plateau' WHEN time_bin < '19:00' THEN 'Afternoon Peak' ELSE 'Evening Decline' END AS segment, sum(total_volume)::BIGINT AS total_volume, count(*) AS bins FROM bins GROUP BY 1) SELECT *, total_volume::DOUBLE * 100 / sum(total_volume) OVER () AS share_pct FROM x")
add(
    "window_stats",
    lambda t: _r6(P.window_stats(bins(t)), "avg_daily_volume_sum"),
    ", w(window_name, a, b) AS (VALUES ('Morning Peak Window 07:00–09:30', '07:00', '09:30'), ('Midday Plateau 10:00–15:00', '10:00', '15:00'), ('Afternoon Peak Window 16:00–18:30', '16:00', '18:30'), ('Overnight Baseline 00:00–05:00', '00:00', '05:00')), "
    "j AS (SELECT * FROM w JOIN bins ON time_bin >= a AND time_bin < b) SELECT window_name, count(*) AS bins, sum(total_volume)::BIGINT AS volume, round(sum(avg_daily_volume), 6) AS avg_daily_volume_sum, sum(total_volume)::DOUBLE * 100 / (SELECT sum(total_volume) FROM bins) AS share_pct, "
    "arg_max(time_bin, (avg_daily_volume, -(time_bin[1:2]::INTEGER * 60 + time_bin[4:5]::INTEGER))) AS strongest_bin, max(avg_daily_volume) AS strongest_bin_avg FROM j GROUP BY 1",
)
_END = "(SELECT {0} FROM x WHERE {1} IS NOT NULL ORDER BY {1} {2}, count_date LIMIT 1)"
add(
    "daily_summary",
    lambda t: P.daily_summary(t.daily),
    ", x AS (SELECT *, day_total_volume AS v, day_total_volume - lag(day_total_volume) OVER (ORDER BY count_date) AS c FROM daily) SELECT count(*) AS days, min(count_date) AS first_date, max(count_date) AS last_date, sum(v)::BIGINT AS total_volume, avg(v) AS mean, median(v)::DOUBLE AS median, "
    + ", ".join(f"{_END.format(c, c, o)} AS {n}, {_END.format('count_date', c, o)} AS {n}_date" for n, c, o in (("busiest_day", "v", "DESC"), ("quietest_day", "v", ""), ("biggest_rise", "c", "DESC"), ("biggest_fall", "c", "")))
    + " FROM x",
)
add("completion_summary", lambda t: core.monthly_totals(t.day_bins, core.month_calendar(t.day_bins, extra=1)).agg(F.count("*").alias("months_total"), F.count_if(F.col("row_type") == "data").alias("months_with_data"), F.expr("listagg(month_label, ',') WITHIN GROUP (ORDER BY month_label) FILTER (WHERE row_type = 'zero_row_month')").alias("zero_months")),
    ", cal AS (SELECT unnest(generate_series(date_trunc('month', min(count_date)), date_trunc('month', max(count_date)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS m FROM obs), x AS (SELECT strftime(m, '%Y-%m') AS l, month_total_volume AS v FROM cal LEFT JOIN monthly ON month_label = strftime(m, '%Y-%m')) SELECT count(*) AS months_total, count(v) AS months_with_data, string_agg(l, ',' ORDER BY l) FILTER (v IS NULL) AS zero_months FROM x")
