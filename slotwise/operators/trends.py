"""Rolling, growth and shock series over small daily, monthly or yearly tables; and comparisons of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import ordered



def rolling_mean(df: DataFrame, order: str, value: str, n: int, least: int, name: str) -> DataFrame:
    return df.withColumn(name, C.rolling(F.col(value), Window.orderBy(order), n, least))


def lag_growth(df: DataFrame, order: str, value: str, rows: int, name: str = "growth_pct") -> DataFrame:
    """Change in per cent against ``rows`` rows before."""
    before = F.lag(value, rows).over(Window.orderBy(order))
    return df.withColumn(name, C.pct(F.col(value) - before, before))


def mask_gaps(monthly: DataFrame, months: list[str], value: str = "month_total_volume") -> DataFrame:
    """Zero in a known gap month becomes null."""
    return monthly.withColumn(value, F.when(~(F.col("month_label").isin(months) & (F.col(value) == 0)), F.col(value)))


def drop_partial_tail(monthly: DataFrame, value: str = "month_total_volume") -> DataFrame:
    """Without the last month if it is under 0.75 of the median of the six before; only with more than eight months."""
    back = Window.orderBy(F.desc("month_label"))
    marked = monthly.withColumns({"_r": F.row_number().over(back), "_n": F.count("*").over(Window.partitionBy()), "_m": F.percentile(value, F.lit(0.5)).over(Window.orderBy("month_label").rowsBetween(-6, -1))})
    return marked.filter(~((F.col("_r") == 1) & (F.col("_n") > 8) & (F.col(value) < 0.75 * F.col("_m")))).drop("_r", "_n", "_m")


def month_table(calendar_totals: DataFrame, profile: DataFrame) -> DataFrame:
    """Months of the calendar (``core.monthly_totals``) with their days and average day; both are null in a month without rows."""
    return calendar_totals.join(profile.select("month_label", "days_loaded", "avg_daily_volume"), "month_label", "left")


def year_trend(months: DataFrame) -> DataFrame:
    """Of each year: total, mean of the months' average days, days, months and months with rows, partial flag, running total; growth and index over full years.

    A year is partial with under 12 valid months. It counts as a full year for growth and index (first full year = 100) unless it is partial without
    a month known to be empty, as the running year is.
    """
    empty = F.col("row_type") == "zero_row_month"
    years = months.groupBy(F.substring("month_label", 1, 4).cast("int").alias("year")).agg(
        F.sum("month_total_volume").alias("total_volume"), F.avg("avg_daily_volume").alias("avg_daily_volume"), F.sum("days_loaded").alias("days_loaded"), F.count("*").alias("months_loaded"), F.count_if(empty).alias("empty")
    )
    w = Window.orderBy("year")
    total = F.col("total_volume")
    out = years.withColumn("valid_months", F.col("months_loaded") - F.col("empty")).withColumns({"is_partial": F.col("valid_months") < 12, "cumulative_volume": F.sum(total).over(w)})
    full = out.filter("not is_partial or empty > 0").withColumn("_before", F.lag("total_volume").over(w))
    full = full.select("year", C.pct(total - F.col("_before"), F.col("_before")).alias("yoy_pct"), C.pct(total, F.first("total_volume").over(w)).alias("index"))
    return out.drop("empty").join(full, "year", "left")


def momentum(monthly: DataFrame) -> DataFrame:
    """Change against the month before and its mean over three changes, without an obviously partial last month."""
    whole = lag_growth(drop_partial_tail(monthly), "month_label", "month_total_volume", 1)
    return rolling_mean(whole, "month_label", "growth_pct", 3, 3, "mean_3")


def shock_timeline(monthly: DataFrame, n: int = 12, least: int = 6, cut: float = 2.0) -> DataFrame:
    """Rolling median and deviation of the last n months, z of this one, class at +-cut."""
    w = Window.orderBy("month_label")
    v = F.col("month_total_volume")
    out = monthly.withColumns({"rolling_median": C.rolling(v, w, n, least, lambda c: F.percentile(c, F.lit(0.5))), "rolling_sd": C.rolling(v, w, n, least, F.stddev_samp)})
    z = C.safe_div(v - F.col("rolling_median"), F.col("rolling_sd"))
    return out.withColumn("z_score", z).withColumn("shock_type", C.first_match((F.col("z_score") >= cut, "Positive shock"), (F.col("z_score") <= -cut, "Negative shock"), otherwise="Normal"))


def site_anomalies(sm: DataFrame) -> DataFrame:
    """Ratio to the site's mean of 12 rows (at least 3), flagged from 1.5 and to 0.5."""
    mean = C.rolling(F.col("month_site_volume"), Window.partitionBy("site_id").orderBy("month_label"), 12, 3)
    out = sm.withColumn("rolling_mean", mean).withColumn("ratio", C.safe_div(F.col("month_site_volume"), F.col("rolling_mean")))
    return out.withColumn("flag", C.first_match((F.col("ratio") >= 1.5, "spike"), (F.col("ratio") <= 0.5, "drop"), otherwise="normal"))


def weekday_weekend_trend(split: DataFrame) -> DataFrame:
    """Shares and average days of weekdays and weekends by month, weekend intensity (per cent of the average weekday), mean weekend share of 12 rows (6 at least), running totals. A month without volume has nulls and adds nothing."""
    w = Window.orderBy("month_label")
    names = ["weekday_volume", "weekend_volume", "weekday_days", "weekend_days"]
    both = F.col("weekday_volume") + F.col("weekend_volume")
    known = split.withColumn("total_volume", F.when(both != 0, both)).withColumns({c: F.when(both != 0, F.col(c)) for c in names})
    out = known.withColumns({
        "weekday_share_pct": C.pct(F.col("weekday_volume"), F.col("total_volume")), "weekend_share_pct": C.pct(F.col("weekend_volume"), F.col("total_volume")),
        "weekday_avg": C.safe_div(F.col("weekday_volume"), F.col("weekday_days")), "weekend_avg": C.safe_div(F.col("weekend_volume"), F.col("weekend_days")),
    }).withColumn("weekend_intensity", C.pct(F.col("weekend_avg"), F.col("weekday_avg")))
    running = {n: F.sum(F.coalesce(c, F.lit(0))).over(w) for n, c in (("running_weekday", "weekday_volume"), ("running_weekend", "weekend_volume"), ("running_total", "total_volume"))}
    return out.withColumn("weekend_share_12", C.rolling(F.col("weekend_share_pct"), w, 12, 6)).withColumns(running)


def cumulative_share(df: DataFrame, order: str, value: str, name: str = "cumulative_share_pct") -> DataFrame:
    return df.withColumn(name, C.pct(F.sum(value).over(Window.orderBy(order)), F.sum(value).over(Window.partitionBy())))


def time_at_share(bins: DataFrame, targets: list[float]) -> DataFrame:
    """The first bin at which the running share reaches each target."""
    run = cumulative_share(bins, "time_bin", "total_volume")
    before = F.lag("cumulative_share_pct").over(Window.orderBy("time_bin"))
    return run.withColumn("reached", ordered.crossed(before, F.col("cumulative_share_pct"), targets)).select(F.explode("reached").alias("target_pct"), "time_bin")


def dow_shape(dow: DataFrame) -> DataFrame:
    """Running share of the week; build-up from Monday (Monday to Friday) and drop from Friday (Friday to Sunday) of the average day, in per cent; null on other days."""
    own = lambda d: F.max(F.when(F.col("iso_dow") == d, F.col("avg_daily_volume"))).over(Window.partitionBy())
    v, day = F.col("avg_daily_volume"), F.col("iso_dow")
    drop, build = (1 - C.safe_div(v, own(5))) * 100, (C.safe_div(v, own(1)) - 1) * 100
    return cumulative_share(dow, "iso_dow", "total_volume").withColumns({"drop_from_friday_pct": F.when(day >= 5, drop), "build_from_monday_pct": F.when(day <= 5, build)})


def dow_volatility(dow_month: DataFrame) -> DataFrame:
    """Mean, sample deviation and coefficient of variation (per cent) of each weekday's average day over the months."""
    v = F.col("avg_daily_volume")
    return dow_month.groupBy("iso_dow").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).withColumn("coefficient_of_variation_pct", C.pct(F.col("sd"), F.col("mean")))


def month_gaps(present: DataFrame, calendar: DataFrame) -> DataFrame:
    """Months of the calendar that no row has."""
    return calendar.join(present.select("month_label").distinct(), "month_label", "left_anti").select("month_label")


def day_shape(bins: DataFrame) -> DataFrame:
    """One row: ratios of the day's curve (08:00 to 05:00, 17:15 to 21:00, afternoon to morning peak, busiest to quietest bin by total), and its running share up to and with four times."""
    t, v = F.col("time_bin"), F.col("avg_daily_volume")
    top = lambda a, b: F.max(F.when((t >= a) & (t < b), v))
    at = lambda x: F.sum(F.when(t == x, v))
    share = lambda x: C.pct(F.sum(F.when(t <= x, F.col("total_volume")).otherwise(0)), F.sum("total_volume"))
    total = lambda order: F.min_by("total_volume", F.struct(order, t))
    return bins.agg(
        C.safe_div(at("08:00"), at("05:00")).alias("morning_ramp"), C.safe_div(at("17:15"), at("21:00")).alias("evening_decay"), C.safe_div(top("13:00", "19:00"), top("05:00", "11:00")).alias("pm_to_am_peak"), C.safe_div(total(-v), total(v)).alias("peak_to_quiet"),
        *[share(f"{h}:00").alias(f"share_by_{h}") for h in ("09", "12", "17", "19")],
    )


def plateau(bins: DataFrame, thresholds: list[float]) -> DataFrame:
    """Bins (and hours) at or above a share of the peak."""
    share = C.pct(F.col("avg_daily_volume"), F.max("avg_daily_volume").over(Window.partitionBy()))
    held = bins.withColumn("of_peak_pct", share).withColumn("threshold_pct", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: x <= F.col("of_peak_pct"))))
    return held.groupBy("threshold_pct").agg(F.count("*").alias("bins"), (F.count("*") / F.lit(4.0)).alias("hours"), F.min("time_bin").alias("first_bin"), F.max("time_bin").alias("last_bin"))


def era_profile(dow_month: DataFrame, era: Column) -> DataFrame:
    """Average day of each weekday by era, and its index to the era's Friday."""
    out = dow_month.groupBy(era.alias("era"), "iso_dow").agg(F.sum("total_volume").alias("v"), F.sum("days_loaded").alias("d")).withColumn("avg_daily_volume", C.safe_div(F.col("v"), F.col("d")))
    friday = F.max(F.when(F.col("iso_dow") == 5, F.col("avg_daily_volume"))).over(Window.partitionBy("era"))
    return out.select("era", "iso_dow", "avg_daily_volume", C.pct(F.col("avg_daily_volume"), friday).alias("friday_index"))


def era_months(months: DataFrame, era: Column) -> DataFrame:
    """Mean of the average day of each calendar month by era, from (month_label, avg_daily_volume)."""
    return months.groupBy(era.alias("era"), F.substring("month_label", 6, 2).cast("int").alias("month_of_year")).agg(F.avg("avg_daily_volume").alias("avg_daily_volume"))


def period_rows(obs: DataFrame, periods: list[tuple[str, str]]) -> DataFrame:
    """Observations of chosen days, with their period's name and number (from 0). The days are a literal table."""
    table = obs.sparkSession.createDataFrame([(d, n, i) for i, (d, n) in enumerate(periods)], "d string, period string, sequence int").withColumn("d", F.to_date("d"))
    return obs.filter(F.col("count_date").isin(*[F.lit(d).cast("date") for d, _ in periods])).join(F.broadcast(table), F.col("count_date") == F.col("d")).drop("d")


def period_summary(rows: DataFrame, baseline: str) -> DataFrame:
    out = rows.groupBy("period").agg(F.sum("volume_15m").alias("total_volume"), F.countDistinct("site_id").alias("active_sites"))
    return out.withColumn("index", C.pct(F.col("total_volume"), F.max(F.when(F.col("period") == baseline, F.col("total_volume"))).over(Window.partitionBy())))


def hourly_change(rows: DataFrame, baseline: str) -> DataFrame:
    out = rows.groupBy("period", (F.col("interval_index") / 4).cast("int").alias("hour")).agg(F.sum("volume_15m").alias("v"))
    base = F.max(F.when(F.col("period") == baseline, F.col("v"))).over(Window.partitionBy("hour"))
    return out.withColumn("change_pct", C.pct(F.col("v") - base, base)).filter(F.col("period") != baseline)


def site_period_change(rows: DataFrame, periods: list[str]) -> DataFrame:
    """Volume of each site on three days (baseline, shock, busiest): what the shock took off the baseline and what the busiest day has over it, absolute and in per cent of the baseline (null without one)."""
    base, shock, busiest = periods
    wide = rows.groupBy("site_id").pivot("period", periods).agg(F.sum("volume_15m"))
    wide = wide.select("site_id", *[F.coalesce(F.col(p), F.lit(0)).alias(p) for p in periods])
    share = lambda c: F.when(F.col(base) > 0, C.pct(c, F.col(base)))
    lost, grown = F.col(base) - F.col(shock), F.col(busiest) - F.col(base)
    return wide.withColumns({"collapse": lost, "collapse_pct": share(lost), "growth": grown, "growth_pct": share(grown)})


def recovery_scatter(changes: DataFrame, periods: list[str], floor: float) -> DataFrame:
    """Indices (baseline = 100) of the shock and of the busiest day, of sites whose baseline is at least the larger of ``floor`` and its 10th percentile; negative or missing ones go."""
    base, shock, busiest = periods
    cut = changes.agg(F.greatest(F.lit(float(floor)), F.percentile(base, F.lit(0.1))).alias("cut"))
    kept = changes.crossJoin(F.broadcast(cut)).filter(F.col(base) >= F.col("cut"))
    return kept.select("site_id", base, C.pct(F.col(shock), F.col(base)).alias("shock_index"), C.pct(F.col(busiest), F.col(base)).alias("busiest_index")).filter("shock_index >= 0 and busiest_index >= 0")

