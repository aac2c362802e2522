"""Queries: windows, trends and comparisons of periods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core
from slotwise.operators import ordered as O
from slotwise.operators import profiles as P
from slotwise.operators import sites as S
from slotwise.operators import trends as T
from slotwise.plans.base import add
from slotwise.plans.profiles import _SPLIT, DATE, DOW, _r6, bins

dow_month = lambda t: core.profile(t.day_bins, month_label=C.month_label(DATE), iso_dow=C.iso_dow(DATE))

add("rolling_mean", lambda t: _r6(T.rolling_mean(T.rolling_mean(t.daily, "count_date", "day_total_volume", 7, 3, "mean_7"), "count_date", "day_total_volume", 30, 10, "mean_30"), "mean_7", "mean_30"),
    "SELECT *, round(CASE WHEN count(*) OVER a >= 3 THEN avg(day_total_volume) OVER a END, 6) AS mean_7, round(CASE WHEN count(*) OVER b >= 10 THEN avg(day_total_volume) OVER b END, 6) AS mean_30 FROM daily WINDOW a AS (ORDER BY count_date ROWS 6 PRECEDING), b AS (ORDER BY count_date ROWS 29 PRECEDING)")
add("daily_change", lambda t: t.daily.withColumn("change", F.col("day_total_volume") - F.lag("day_total_volume").over(Window.orderBy("count_date"))), "SELECT *, day_total_volume - lag(day_total_volume) OVER (ORDER BY count_date) AS change FROM daily")
_MASK = ", g AS (SELECT month_label, month_total_volume AS v FROM monthly), m AS (SELECT month_label, CASE WHEN NOT (month_label IN ('1995-03', '2001-12') AND v = 0) THEN v END AS month_total_volume FROM g)"
gapped = lambda t: T.mask_gaps(t.monthly, ["1995-03", "2001-12"])
add("mask_gaps_rolling_6", lambda t: _r6(T.rolling_mean(gapped(t), "month_label", "month_total_volume", 6, 1, "mean_6"), "mean_6"), _MASK + " SELECT *, round(avg(month_total_volume) OVER (ORDER BY month_label ROWS 5 PRECEDING), 6) AS mean_6 FROM m")
add("drop_partial_tail", lambda t: T.drop_partial_tail(t.monthly), ", x AS (SELECT *, row_number() OVER (ORDER BY month_label DESC) AS r, count(*) OVER () AS n FROM monthly), md AS (SELECT median(month_total_volume) AS md FROM x WHERE r BETWEEN 2 AND 7) SELECT month_label, month_total_volume FROM x, md WHERE NOT (r = 1 AND n > 8 AND month_total_volume < 0.75::DOUBLE * md)")
for name, rows in (("yoy_growth", 12), ("momentum_raw", 1)):
    add(name, lambda t, rows=rows: T.lag_growth(t.monthly, "month_label", "month_total_volume", rows), f"SELECT *, (month_total_volume - lag(month_total_volume, {rows}) OVER w)::DOUBLE * 100 / nullif(lag(month_total_volume, {rows}) OVER w, 0) AS growth_pct FROM monthly WINDOW w AS (ORDER BY month_label)")
_MD = ", n AS (SELECT *, row_number() OVER (ORDER BY month_label DESC) AS r, count(*) OVER () AS n FROM monthly), md AS (SELECT median(month_total_volume) AS md FROM n WHERE r BETWEEN 2 AND 7), wm AS (SELECT month_label, month_total_volume FROM n, md WHERE NOT (r = 1 AND n > 8 AND month_total_volume < 0.75::DOUBLE * md))"
add(
    "momentum",
    lambda t: _r6(T.momentum(t.monthly), "growth_pct", "mean_3"),
    _MD + ", x AS (SELECT *, (month_total_volume - lag(month_total_volume) OVER w)::DOUBLE * 100 / lag(month_total_volume) OVER w AS g FROM wm WINDOW w AS (ORDER BY month_label)) SELECT month_label, month_total_volume, round(g, 6) AS growth_pct, round(CASE WHEN count(g) OVER m = 3 THEN avg(g) OVER m END, 6) AS mean_3 FROM x WINDOW m AS (ORDER BY month_label ROWS 2 PRECEDING)",
)
_CALM = ", cal AS (SELECT unnest(generate_series(date_trunc('month', min(count_date)), date_trunc('month', max(count_date)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS m FROM obs), mt AS (SELECT strftime(m, '%Y-%m') AS month_label, coalesce(v, 0)::BIGINT AS month_total_volume, d AS days_loaded, v / d::DOUBLE AS avg_daily_volume, v IS NULL AS empty FROM cal LEFT JOIN (SELECT strftime(count_date, '%Y-%m') AS l, sum(volume_15m)::BIGINT AS v, count(DISTINCT count_date) AS d FROM obs GROUP BY 1) ON l = strftime(m, '%Y-%m'))"
_YT = (
    _CALM + ", y AS (SELECT month_label[1:4]::INTEGER AS year, sum(month_total_volume)::BIGINT AS total_volume, round(avg(avg_daily_volume), 6) AS avg_daily_volume, sum(days_loaded)::BIGINT AS days_loaded, count(*) AS months_loaded, count(*) FILTER (NOT empty) AS valid_months FROM mt GROUP BY 1), "
    "f AS (SELECT year, (total_volume - lag(total_volume) OVER w)::DOUBLE * 100 / lag(total_volume) OVER w AS yoy_pct, total_volume::DOUBLE * 100 / first_value(total_volume) OVER w AS index FROM y WHERE valid_months >= 12 OR valid_months < months_loaded WINDOW w AS (ORDER BY year)), "
    "yt AS (SELECT y.*, valid_months < 12 AS is_partial, (sum(total_volume) OVER (ORDER BY year))::BIGINT AS cumulative_volume, yoy_pct, index FROM y LEFT JOIN f USING (year))"
)
year_trend = lambda t: _r6(T.year_trend(T.month_table(core.monthly_totals(t.day_bins, core.month_calendar(t.day_bins, extra=1)), core.profile(t.day_bins, month_label=C.month_label(DATE)))), "avg_daily_volume")
add("year_trend", year_trend, _YT + " SELECT * FROM yt")
add("annual_growth", lambda t: year_trend(t).withColumn("last", F.max("year").over(Window.partitionBy())).filter("year < last").select("year", "total_volume", "yoy_pct"), _YT + " SELECT year, total_volume, yoy_pct FROM yt WHERE year < (SELECT max(year) FROM yt)")
add("shock_timeline", lambda t: _r6(T.shock_timeline(t.monthly), "rolling_sd", "z_score"),
    ", x AS (SELECT *, CASE WHEN count(*) OVER w >= 6 THEN median(month_total_volume) OVER w END::DOUBLE AS rolling_median, CASE WHEN count(*) OVER w >= 6 THEN stddev_samp(month_total_volume) OVER w END AS sd FROM monthly WINDOW w AS (ORDER BY month_label ROWS 11 PRECEDING)), z AS (SELECT *, (month_total_volume - rolling_median) / sd AS z FROM x) SELECT month_label, month_total_volume, rolling_median, round(sd, 6) AS rolling_sd, round(z, 6) AS z_score, CASE WHEN z >= 2 THEN 'Positive shock' WHEN z <= -2 THEN 'Negative shock' ELSE 'Normal' END AS shock_type FROM z")
add("site_anomalies", lambda t: _r6(T.site_anomalies(t.sm), "rolling_mean", "ratio"), ", x AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(month_site_volume) OVER w END AS m FROM sm WINDOW w AS (PARTITION BY site_id ORDER BY month_label ROWS 11 PRECEDING)), y AS (SELECT *, month_site_volume / nullif(m, 0) AS r FROM x) SELECT month_label, site_id, month_site_volume, round(m, 6) AS rolling_mean, round(r, 6) AS ratio, CASE WHEN r >= 1.5 THEN 'spike' WHEN r <= 0.5 THEN 'drop' ELSE 'normal' END AS flag FROM y")
add("site_network_share", lambda t: t.sm.join(F.broadcast(t.monthly), "month_label").select("month_label", "site_id", C.pct(F.col("month_site_volume"), F.col("month_total_volume")).alias("share_pct")), "SELECT month_label, site_id, month_site_volume::DOUBLE * 100 / month_total_volume AS share_pct FROM sm JOIN monthly USING (month_label)")
add(
    "weekday_weekend_trend",
    lambda t: _r6(T.weekday_weekend_trend(core.weekday_weekend(t.day_bins, C.month_label(DATE).alias("month_label"))), "weekend_share_12"),
    f", s AS (SELECT strftime(count_date, '%Y-%m') AS month_label, {_SPLIT} GROUP BY 1), k AS (SELECT month_label, nullif(weekday_volume + weekend_volume, 0) AS total_volume, CASE WHEN weekday_volume + weekend_volume <> 0 THEN weekday_volume END AS weekday_volume, CASE WHEN weekday_volume + weekend_volume <> 0 THEN weekend_volume END AS weekend_volume, "
    "CASE WHEN weekday_volume + weekend_volume <> 0 THEN weekday_days END AS weekday_days, CASE WHEN weekday_volume + weekend_volume <> 0 THEN weekend_days END AS weekend_days FROM s), "
    "x AS (SELECT *, weekday_volume::DOUBLE * 100 / total_volume AS weekday_share_pct, weekend_volume::DOUBLE * 100 / total_volume AS weekend_share_pct, weekday_volume / nullif(weekday_days, 0)::DOUBLE AS weekday_avg, weekend_volume / nullif(weekend_days, 0)::DOUBLE AS weekend_avg FROM k) "
    "SELECT *, weekend_avg * 100 / nullif(weekday_avg, 0) AS weekend_intensity, round(CASE WHEN count(weekend_share_pct) OVER w >= 6 THEN avg(weekend_share_pct) OVER w END, 6) AS weekend_share_12, "
    + ", ".join(f"(sum(coalesce({c}, 0)) OVER r)::BIGINT AS {n}" for n, c in (("running_weekday", "weekday_volume"), ("running_weekend", "weekend_volume"), ("running_total", "total_volume")))
    + " FROM x WINDOW w AS (ORDER BY month_label ROWS 11 PRECEDING), r AS (ORDER BY month_label)",
)
_CUM = ", c AS (SELECT time_bin, total_volume, avg_daily_volume, (sum(total_volume) OVER (ORDER BY time_bin))::DOUBLE * 100 / sum(total_volume) OVER () AS cumulative_share_pct FROM bins)"
add("cumulative_day_share", lambda t: T.cumulative_share(bins(t).drop("days_loaded"), "time_bin", "total_volume"), _CUM + " SELECT * FROM c")
add("time_at_share", lambda t: T.time_at_share(bins(t), [25, 50, 75]), _CUM + ", n(target_pct) AS (VALUES (25::DOUBLE), (50), (75)) SELECT target_pct, min(time_bin) AS time_bin FROM n JOIN c ON cumulative_share_pct >= target_pct GROUP BY 1")
_CURVE = ", cv AS (SELECT site_id, total_volume, rank, cumulative_volume, cumulative_volume::DOUBLE * 100 / network_volume AS cumulative_share_pct, rank::DOUBLE * 100 / sites AS site_share_pct FROM rk)"
add("concentration_curve", lambda t: S.concentration_curve(t.site_totals), _CURVE + " SELECT * FROM cv")
add("concentration_milestones", lambda t: S.concentration_milestones(t.site_totals, [10, 20, 50, 80, 95]), _CURVE + ", n(target_pct) AS (VALUES (10::DOUBLE), (20), (50), (80), (95)) SELECT target_pct, min(rank) AS sites_needed FROM n JOIN cv ON cumulative_share_pct >= target_pct GROUP BY 1")
add("pct_rank", lambda t: t.obs_days.groupBy("site_id").agg(F.sum("volume_15m").alias("v")).transform(O.pct_rank, "v").withColumn("pct_rank", F.round(F.coalesce("pct_rank", F.lit(0.0)), 9)), ", x AS (SELECT site_id, sum(volume_15m)::BIGINT AS v FROM obs_days GROUP BY 1) SELECT *, round(CASE WHEN v IS NULL THEN 0 ELSE (rank() OVER (ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY v) - 1) / 2::DOUBLE) / count(v) OVER () END, 9) AS pct_rank FROM x")
add("dow_shape", lambda t: T.dow_shape(core.profile(t.day_bins, **DOW())), ", f AS (SELECT max(avg_daily_volume) FILTER (iso_dow = 5) AS f, max(avg_daily_volume) FILTER (iso_dow = 1) AS m FROM dow) SELECT dow.*, (sum(total_volume) OVER (ORDER BY iso_dow))::DOUBLE * 100 / sum(total_volume) OVER () AS cumulative_share_pct, CASE WHEN iso_dow >= 5 THEN (1 - avg_daily_volume / f) * 100 END AS drop_from_friday_pct, CASE WHEN iso_dow <= 5 THEN (avg_daily_volume / m - 1) * 100 END AS build_from_monday_pct FROM dow, f")
add("dow_volatility", lambda t: _r6(T.dow_volatility(dow_month(t)), "mean", "sd", "coefficient_of_variation_pct"), "SELECT iso_dow, round(avg(avg_daily_volume), 6) AS mean, round(stddev_samp(avg_daily_volume), 6) AS sd, round(stddev_samp(avg_daily_volume) * 100 / avg(avg_daily_volume), 6) AS coefficient_of_variation_pct FROM dow_month GROUP BY 1")
add("month_gaps", lambda t: T.month_gaps(t.monthly, core.month_calendar(t.day_bins, extra=1)), ", cal AS (SELECT unnest(generate_series(date_trunc('month', min(count_date)), date_trunc('month', max(count_date)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS m FROM obs) SELECT strftime(m, '%Y-%m') AS month_label FROM cal WHERE month_label NOT IN (SELECT month_label FROM monthly)")
add(
    "day_shape",
    lambda t: T.day_shape(bins(t)),
    "SELECT sum(avg_daily_volume) FILTER (time_bin = '08:00') / sum(avg_daily_volume) FILTER (time_bin = '05:00') AS morning_ramp, sum(avg_daily_volume) FILTER (time_bin = '17:15') / sum(avg_daily_volume) FILTER (time_bin = '21:00') AS evening_decay, "
    "max(avg_daily_volume) FILTER (time_bin >= '13:00' AND time_bin < '19:00') / max(avg_daily_volume) FILTER (time_bin >= '05:00' AND time_bin < '11:00') AS pm_to_am_peak, "
    "(SELECT total_volume FROM bins ORDER BY avg_daily_volume DESC, time_bin LIMIT 1)::DOUBLE / (SELECT total_volume FROM bins ORDER BY avg_daily_volume, time_bin LIMIT 1) AS peak_to_quiet, "
    + ", ".join(f"coalesce(sum(total_volume) FILTER (time_bin <= '{h}:00'), 0)::DOUBLE * 100 / sum(total_volume) AS share_by_{h}" for h in ("09", "12", "17", "19")) + " FROM bins",
)
add("plateau", lambda t: T.plateau(bins(t), [70, 80, 90]), ", n(threshold_pct) AS (VALUES (70::DOUBLE), (80), (90)), x AS (SELECT *, avg_daily_volume * 100 / max(avg_daily_volume) OVER () AS p FROM bins) SELECT threshold_pct, count(*) AS bins, count(*) / 4::DOUBLE AS hours, min(time_bin) AS first_bin, max(time_bin) AS last_bin FROM n JOIN x ON p >= threshold_pct GROUP BY 1")
era = lambda: C.first_match((F.col("month_label") < "1998-01", "early"), (F.col("month_label") < "2000-01", "middle"), otherwise="late")
add("era_profile", lambda t: T.era_profile(dow_month(t), era()), ", e AS (SELECT CASE WHEN month_label < '1998-01' THEN 'early' WHEN month_label < '2000-01' THEN 'middle' ELSE 'late' END AS era, iso_dow, sum(total_volume) / sum(days_loaded)::DOUBLE AS avg_daily_volume FROM dow_month GROUP BY 1, 2) SELECT *, avg_daily_volume * 100 / max(avg_daily_volume) FILTER (iso_dow = 5) OVER (PARTITION BY era) AS friday_index FROM e")
add(
    "era_months",
    lambda t: _r6(T.era_months(core.profile(t.day_bins, month_label=C.month_label(DATE)), era()), "avg_daily_volume"),
    ", m AS (SELECT strftime(count_date, '%Y-%m') AS l, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS a FROM obs GROUP BY 1) SELECT CASE WHEN l < '1998-01' THEN 'early' WHEN l < '2000-01' THEN 'middle' ELSE 'late' END AS era, l[6:7]::INTEGER AS month_of_year, round(avg(a), 6) AS avg_daily_volume FROM m GROUP BY 1, 2",
)
_WD = {d: n for d, n in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"), 1)}


def yearly_days(t):  # noqa: ANN001, ANN201
    wide = P.matrix(core.profile(t.day_bins, year=F.year(DATE), iso_dow=C.iso_dow(DATE)), F.col("year"), "iso_dow", list(_WD), "avg_daily_volume", F.max)
    wide = wide.select("year", *[F.col(str(d)).alias(n) for d, n in _WD.items()])
    over = lambda a, b: (C.safe_div(a, b) - 1) * 100
    rest = [F.col(d) for d in ("tue", "wed", "thu", "fri")]
    week = C.safe_div(sum((F.coalesce(c, F.lit(0.0)) for c in rest[1:]), F.coalesce(rest[0], F.lit(0.0))), sum((c.isNotNull().cast("int") for c in rest[1:]), rest[0].isNotNull().cast("int")))
    return wide.withColumns({"friday_vs_monday_pct": over(F.col("fri"), F.col("mon")), "friday_vs_sunday_pct": over(F.col("fri"), F.col("sun")), "monday_vs_weekday_avg_pct": over(F.col("mon"), week)})


add("yearly_day_metrics", yearly_days, ", x AS (SELECT year(count_date)::INTEGER AS year, isodow(count_date) AS d, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS v FROM obs GROUP BY 1, 2), y AS (SELECT year, " + ", ".join(f"max(v) FILTER (d = {d}) AS {n}" for d, n in _WD.items()) + " FROM x GROUP BY 1) SELECT *, (fri / mon - 1) * 100 AS friday_vs_monday_pct, (fri / sun - 1) * 100 AS friday_vs_sunday_pct, (mon / ((coalesce(tue, 0) + coalesce(wed, 0) + coalesce(thu, 0) + coalesce(fri, 0)) / nullif((tue IS NOT NULL)::INT + (wed IS NOT NULL)::INT + (thu IS NOT NULL)::INT + (fri IS NOT NULL)::INT, 0)) - 1) * 100 AS monday_vs_weekday_avg_pct FROM y")
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MM = [(f"{i:02d}", n) for i, n in enumerate(MONTHS, 1)]
add(
    "month_matrix",
    lambda t: P.matrix(t.monthly.withColumns({"year": F.substring("month_label", 1, 4).cast("int"), "m": F.substring("month_label", 6, 2)}), F.col("year"), "m", [m for m, _ in _MM], "month_total_volume").select("year", *[F.col(m).alias(n) for m, n in _MM]),
    "SELECT month_label[1:4]::INTEGER AS year, " + ", ".join(f"sum(month_total_volume) FILTER (month_label[6:7] = '{m}')::BIGINT AS {n}" for m, n in _MM) + " FROM monthly GROUP BY 1",
)


def month_days(t):  # noqa: ANN001, ANN201
    wide = P.matrix(core.profile(t.day_bins, month_of_year=F.month(DATE), iso_dow=C.iso_dow(DATE)), F.col("month_of_year"), "iso_dow", list(_WD), "avg_daily_volume", F.max)
    return wide.select("month_of_year", *[F.col(str(d)).alias(n) for d, n in _WD.items()])


def weekend_months(t):  # noqa: ANN001, ANN201
    split = core.weekday_weekend(t.day_bins, F.year(DATE).alias("year"), F.date_format(DATE, "MM").alias("m")).withColumn("share", C.pct(F.col("weekend_volume"), F.col("weekday_volume") + F.col("weekend_volume")))
    return P.matrix(split, F.col("year"), "m", [m for m, _ in _MM], "share", F.max).select("year", *[F.col(m).alias(n) for m, n in _MM])


add("month_day_matrix", month_days, ", x AS (SELECT month(count_date)::INTEGER AS month_of_year, isodow(count_date) AS d, sum(volume_15m) / count(DISTINCT count_date)::DOUBLE AS v FROM obs GROUP BY 1, 2) SELECT month_of_year, " + ", ".join(f"max(v) FILTER (d = {d}) AS {n}" for d, n in _WD.items()) + " FROM x GROUP BY 1")
add(
    "weekend_share_matrix",
    weekend_months,
    f", s AS (SELECT year(count_date)::INTEGER AS year, strftime(count_date, '%m') AS m, {_SPLIT} GROUP BY 1, 2), x AS (SELECT year, m, weekend_volume::DOUBLE * 100 / (weekday_volume + weekend_volume) AS v FROM s) SELECT year, "
    + ", ".join(f"max(v) FILTER (m = '{m}') AS {n}" for m, n in _MM) + " FROM x GROUP BY 1",
)
add("weekend_share_by_year", lambda t: core.weekday_weekend(t.day_bins, F.year(DATE).alias("year")).select("year", C.pct(F.col("weekend_volume"), F.col("weekday_volume") + F.col("weekend_volume")).alias("weekend_share_pct")), f", s AS (SELECT year(count_date)::INTEGER AS year, {_SPLIT} GROUP BY 1) SELECT year, weekend_volume::DOUBLE * 100 / (weekday_volume + weekend_volume) AS weekend_share_pct FROM s")
PERIODS = [("2024-01-03", "baseline"), ("2024-01-10", "shock"), ("2024-01-17", "recovery")]
NAMES = [n for _, n in PERIODS]
rows = lambda t: T.period_rows(t.obs_days, PERIODS)
_PER = ", per(d, period) AS (VALUES (DATE '2024-01-03', 'baseline'), (DATE '2024-01-10', 'shock'), (DATE '2024-01-17', 'recovery')), pr AS (SELECT * FROM obs_days JOIN per ON count_date = d)"
add("period_summary", lambda t: T.period_summary(rows(t), "baseline"), _PER + ", x AS (SELECT period, sum(volume_15m)::BIGINT AS total_volume, count(DISTINCT site_id) AS active_sites FROM pr GROUP BY 1) SELECT *, total_volume::DOUBLE * 100 / (SELECT total_volume FROM x WHERE period = 'baseline') AS index FROM x")
add("period_time_bins", lambda t: P.matrix(rows(t), F.col("time_bin"), "period", NAMES, "volume_15m"), _PER + " SELECT time_bin, " + ", ".join(f"sum(volume_15m) FILTER (period = '{n}')::BIGINT AS {n}" for n in NAMES) + " FROM pr GROUP BY 1")
add("hourly_change", lambda t: T.hourly_change(rows(t), "baseline"), _PER + ", x AS (SELECT period, interval_index // 4 AS hour, sum(volume_15m)::BIGINT AS v FROM pr GROUP BY 1, 2) SELECT x.*, (x.v - b.v)::DOUBLE * 100 / nullif(b.v, 0) AS change_pct FROM x LEFT JOIN (SELECT hour, v FROM x WHERE period = 'baseline') b USING (hour) WHERE period <> 'baseline'")
_CH = _PER + ", w AS (SELECT site_id, " + ", ".join(f"coalesce(sum(volume_15m) FILTER (period = '{n}'), 0)::BIGINT AS {n}" for n in NAMES) + " FROM pr GROUP BY 1), ch AS (SELECT *, baseline - shock AS collapse, CASE WHEN baseline > 0 THEN (baseline - shock)::DOUBLE * 100 / baseline END AS collapse_pct, recovery - baseline AS growth, CASE WHEN baseline > 0 THEN (recovery - baseline)::DOUBLE * 100 / baseline END AS growth_pct FROM w)"
add("site_period_change", lambda t: T.site_period_change(rows(t), NAMES), _CH + " SELECT * FROM ch")
for name in ("collapse", "growth"):
    add(
        f"top_{name}",
        lambda t, name=name: core.top(T.site_period_change(rows(t), NAMES).filter(F.col(name) > 0).select("site_id", name, f"{name}_pct"), 30, name, "site_id"),
        _CH + f" SELECT site_id, {name}, {name}_pct, row_number() OVER (ORDER BY {name} DESC, site_id)::INTEGER AS rank FROM ch WHERE {name} > 0 QUALIFY rank <= 30",
    )
add(
    "recovery_scatter",
    lambda t: T.recovery_scatter(T.site_period_change(rows(t), NAMES), NAMES, 50),
    _CH + ", cut AS (SELECT greatest(50, quantile_cont(baseline, 0.1)) AS cut FROM ch) SELECT site_id, baseline, shock::DOUBLE * 100 / baseline AS shock_index, recovery::DOUBLE * 100 / baseline AS busiest_index FROM ch, cut WHERE baseline >= cut AND shock >= 0 AND recovery >= 0",
)
SITE = 1
_SITE = f", s AS (SELECT * FROM sm WHERE site_id = {SITE})"


def site_report(t):  # noqa: ANN001, ANN201
    rows = S.monthly_site_rank(T.site_anomalies(t.sm)).filter(F.col("site_id") == SITE).join(F.broadcast(t.monthly), "month_label")
    return rows.select("month_label", "month_site_volume", C.safe_div(F.col("month_site_volume"), F.col("month_total_volume")).alias("share_of_network"), F.round("ratio", 6).alias("ratio"), "flag", "month_rank", "sites_in_month")


add(
    "site_report",
    site_report,
    ", x AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(month_site_volume) OVER w END AS m, rank() OVER (PARTITION BY month_label ORDER BY month_site_volume DESC)::INTEGER AS month_rank, count(*) OVER (PARTITION BY month_label) AS sites_in_month FROM sm WINDOW w AS (PARTITION BY site_id ORDER BY month_label ROWS 11 PRECEDING)) "
    "SELECT month_label, month_site_volume, month_site_volume::DOUBLE / month_total_volume AS share_of_network, round(month_site_volume / nullif(m, 0), 6) AS ratio, CASE WHEN month_site_volume / nullif(m, 0) >= 1.5 THEN 'spike' WHEN month_site_volume / nullif(m, 0) <= 0.5 THEN 'drop' ELSE 'normal' END AS flag, "
    f"month_rank, sites_in_month FROM x JOIN monthly USING (month_label) WHERE site_id = {SITE}",
)
add("site_report_yearly", lambda t: S.site_years(t.sm.filter(F.col("site_id") == SITE)), _SITE + " SELECT month_label[1:4]::INTEGER AS year, sum(month_site_volume)::BIGINT AS annual_volume, count(*) AS months_seen, avg(month_site_volume) AS avg_month_volume FROM s GROUP BY 1")
add("site_report_months", lambda t: S.site_months_of_year(t.sm.filter(F.col("site_id") == SITE)), _SITE + " SELECT month_label[6:7]::INTEGER AS month_of_year, avg(month_site_volume) AS avg_month_volume, median(month_site_volume)::DOUBLE AS median_month_volume, max(month_site_volume) AS max_month_volume, count(DISTINCT month_label[1:4]) AS years_seen FROM s GROUP BY 1")
