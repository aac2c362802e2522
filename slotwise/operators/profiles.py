"""Summaries over totals and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core


def dataset_summary(site_days: DataFrame) -> DataFrame:
    """Rows, sites, dates and volume of all facts, from the cube of site days."""
    return site_days.agg(F.sum("n_rows").alias("row_count"), F.countDistinct("site_id").alias("distinct_sites"), F.min("count_date").alias("min_date"), F.max("count_date").alias("max_date"), F.sum("volume_15m").alias("total_volume"))


def time_bin_profile(obs: DataFrame) -> DataFrame:
    return core.profile(obs, month_label=C.month_label(F.col("count_date")), time_bin=F.col("time_bin"))


def time_bin_extremes(bins: DataFrame) -> DataFrame:
    """One row: the busiest and the quietest bin by volume a day."""
    hi, lo = core.best(bins, "avg_daily_volume", "time_bin"), core.best(bins, "avg_daily_volume", "time_bin", asc=True)
    return hi.select(F.col("time_bin").alias("best_time_bin"), F.col("avg_daily_volume").alias("best_avg")).crossJoin(lo.select(F.col("time_bin").alias("quietest_time_bin"), F.col("avg_daily_volume").alias("quietest_avg")))


def weekday_vs_weekend(daily: DataFrame) -> DataFrame:
    kind = F.when(C.iso_dow(F.col("count_date")) >= 6, "weekend").otherwise("weekday")
    return daily.groupBy(kind.alias("day_type")).agg(F.count("*").alias("days"), F.avg("day_total_volume").alias("avg_daily_volume"))


def monday_friday_comparison(dow: DataFrame) -> DataFrame:
    own = lambda d: F.max(F.when(F.col("iso_dow") == d, F.col("avg_daily_volume")))
    out = dow.agg(own(1).alias("monday_avg"), own(5).alias("friday_avg"))
    return out.withColumns({"difference": F.col("friday_avg") - F.col("monday_avg"), "pct_difference": C.pct(F.col("friday_avg") - F.col("monday_avg"), F.col("monday_avg"))})


def split_rows(split: DataFrame) -> DataFrame:
    """Weekday and weekend as two rows."""
    row = lambda k: F.struct(F.lit(k).alias("day_type"), F.col(f"{k}_volume").alias("volume"), F.col(f"{k}_days").alias("days"))
    two = F.explode(F.array(row("weekday"), row("weekend")))
    return split.select(two.alias("r")).select("r.*").withColumn("avg_daily_volume", C.safe_div(F.col("volume"), F.col("days")))


def peak_hour_summary(month_bins: DataFrame) -> DataFrame:
    """Best bin by total volume of the day, of 07:00 to 10:00 and of 16:00 to 19:00, from totals by month and bin; averages are over the days of the archive
    (of each month, the most that a bin has)."""
    days = month_bins.groupBy("month_label").agg(F.max("days_loaded").alias("d")).agg(F.sum("d").alias("days"))
    bins = month_bins.groupBy("time_bin").agg(F.sum("total_volume").alias("total"))
    t = F.col("time_bin")
    value = F.struct(F.col("total").alias("v"), (-C.time_bin_to_minutes(t)).alias("m"), t.alias("t"))
    am, pm = (t >= "07:00") & (t < "10:00"), (t >= "16:00") & (t < "19:00")
    out = bins.agg(F.max(value).alias("peak"), F.max(F.when(am, value)).alias("am_peak"), F.max(F.when(pm, value)).alias("pm_peak")).crossJoin(days)
    return out.select(*[c for n in ("peak", "am_peak", "pm_peak") for c in (F.col(f"{n}.t").alias(f"{n}_time_bin"), F.col(f"{n}.v").alias(f"{n}_volume"), C.safe_div(F.col(f"{n}.v"), F.col("days")).alias(f"{n}_avg"))])


def site_extreme_slots(obs: DataFrame) -> DataFrame:
    v = F.col("volume_15m")
    return obs.groupBy("site_id").agg(F.max(v).alias("max_slot_volume"), F.min(F.when(v > 0, v)).alias("min_nonzero_slot_volume"))


def variability(df: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """Count, mean, sample deviation, extremes and coefficient of variation of each key with at least ``least`` rows."""
    out = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.filter(F.col("n") >= least).withColumn("cv", C.safe_div(F.col("sd"), F.col("mean")))


def daily_variability(site_days: DataFrame, least: int = 100) -> DataFrame:
    """Mean, sample deviation and coefficient of variation (4 places; null where the mean is not positive) of each site's daily volumes, of sites with at least ``least`` days."""
    own = variability(site_daily(site_days), "site_id", "v", least)
    cv = F.when(F.col("mean") > 0, F.round("cv", 4))
    return own.select("site_id", F.col("mean").alias("mean_daily_volume"), F.col("sd").alias("sd_daily_volume"), cv.alias("cv"))


def site_daily(obs: DataFrame) -> DataFrame:
    return obs.groupBy("site_id", "count_date").agg(F.sum("volume_15m").alias("v"))


def network_stability(sm: DataFrame) -> DataFrame:
    v = F.col("month_site_volume")
    out = sm.groupBy("month_label").agg(F.sum(v).alias("total_volume"), F.countDistinct("site_id").alias("active_sites"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return out.withColumn("cv", C.safe_div(F.col("sd"), F.col("mean")))


def weekly_pulse(obs: DataFrame) -> DataFrame:
    out = obs.groupBy(C.iso_dow(F.col("count_date")).alias("iso_dow"), "time_bin").agg(F.sum("volume_15m").alias("total_volume"), F.count("*").alias("n_rows"), F.avg("volume_15m").alias("mean_volume"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_volume"), "iso_dow", "time_bin")))


def day_of_year_profile(daily: DataFrame) -> DataFrame:
    """Average by day of year, and its centred mean over 14 rows (at least 3)."""
    days = daily.groupBy(F.dayofyear("count_date").alias("day_of_year")).agg(F.avg("day_total_volume").alias("avg_volume"))
    frame = Window.orderBy("day_of_year").rowsBetween(-7, 6)
    return days.withColumn("centred_mean", F.when(F.count("avg_volume").over(frame) >= 3, F.avg("avg_volume").over(frame)))


def top_weeks(daily: DataFrame, n: int = 20) -> DataFrame:
    label = F.format_string("%d-W%02d", F.extract(F.lit("yearofweek"), "count_date"), F.weekofyear("count_date"))
    weeks = daily.groupBy(label.alias("iso_week")).agg(F.sum("day_total_volume").alias("week_volume"), F.count("*").alias("days"))
    return core.top(weeks, n, "week_volume", "iso_week")


def seasonal_index(months: DataFrame) -> DataFrame:
    """By month of year over (month_label, total_volume, avg_daily_volume): mean, median and deviation of the average day, mean and sum of the months, months, years, index (mean of all = 100)."""
    day, total = F.col("avg_daily_volume"), F.col("total_volume")
    moy = F.substring("month_label", 6, 2).cast("int")
    out = months.groupBy(moy.alias("month_of_year")).agg(
        F.avg(day).alias("avg_daily"), F.median(day).alias("median_daily_volume"), F.avg(total).alias("avg_monthly_volume"), F.sum(total).alias("total"),
        F.stddev_samp(day).alias("std_daily_volume"), F.countDistinct("month_label").alias("months_seen"), F.countDistinct(F.substring("month_label", 1, 4)).alias("years_seen"),
    )
    return out.withColumn("seasonal_index", C.pct(F.col("avg_daily"), F.avg("avg_daily").over(Window.partitionBy()))).withColumnsRenamed({"avg_daily": "avg_daily_volume", "total": "total_volume"})


def month_share_of_year(months: DataFrame) -> DataFrame:
    year = F.substring("month_label", 1, 4)
    shares = months.withColumn("share", C.pct(F.col("month_total_volume"), F.sum("month_total_volume").over(Window.partitionBy(year))))
    return shares.groupBy(F.substring("month_label", 6, 2).cast("int").alias("month_of_year")).agg(F.avg("share").alias("avg_share_pct"))


#: Parts of the day, and windows of behaviour.
SEGMENTS = [("Overnight Quiet", "00:00", "05:00"), ("Morning Build", "05:00", "10:00"), ("Business-Day Plateau", "10:00", "15:00"), ("Afternoon Peak", "15:00", "19:00"), ("Evening Decline", "19:00", "24:00")]
WINDOWS = [("Morning Peak Window 07:00–09:30", "07:00", "09:30"), ("Midday Plateau 10:00–15:00", "10:00", "15:00"), ("Afternoon Peak Window 16:00–18:30", "16:00", "18:30"), ("Overnight Baseline 00:00–05:00", "00:00", "05:00")]


def day_segments(bins: DataFrame) -> DataFrame:
    t = F.col("time_bin")
    part = C.first_match(*[((t >= a) & (t < b), n) for n, a, b in SEGMENTS])
    out = bins.groupBy(part.alias("segment")).agg(F.sum("total_volume").alias("total_volume"), F.count("*").alias("bins"))
    return out.withColumn("share_pct", C.pct(F.col("total_volume"), F.sum("total_volume").over(Window.partitionBy())))


def window_stats(bins: DataFrame, windows: list[tuple[str, str, str]] = WINDOWS) -> DataFrame:
    """Bins, total, average day, share and strongest bin (by average day) of each window; an end at or before its start wraps past midnight. The windows are a literal table."""
    w = bins.sparkSession.createDataFrame(windows, "window_name string, a string, b string")
    t, a, b = F.col("time_bin"), F.col("a"), F.col("b")
    inside = F.when(b > a, (t >= a) & (t < b)).otherwise((t >= a) | (t < b))
    total = bins.agg(F.sum("total_volume").alias("all"))
    strongest = F.max(F.struct(F.col("avg_daily_volume").alias("v"), (-C.time_bin_to_minutes(t)).alias("m"), t.alias("t")))
    out = bins.join(F.broadcast(w), inside).groupBy("window_name").agg(F.count("*").alias("bins"), F.sum("total_volume").alias("volume"), F.sum("avg_daily_volume").alias("avg_daily_volume_sum"), strongest.alias("s"))
    return out.crossJoin(F.broadcast(total)).select("window_name", "bins", "volume", "avg_daily_volume_sum", C.pct(F.col("volume"), F.col("all")).alias("share_pct"), F.col("s.t").alias("strongest_bin"), F.col("s.v").alias("strongest_bin_avg"))


def daily_summary(daily: DataFrame) -> DataFrame:
    """Days and their range, total, mean, median; busiest and quietest day, biggest rise and fall against the day before, each with its date (the first of ties)."""
    change = daily.withColumn("change", F.col("day_total_volume") - F.lag("day_total_volume").over(Window.orderBy("count_date")))
    v = "day_total_volume"
    date = F.col("count_date")
    first = lambda c, low: (F.min if low else F.max)(F.when(c.isNotNull(), F.struct(c.alias("v"), (F.unix_date(date) * (1 if low else -1)).alias("o"), date.alias("d"))))
    ends = {"busiest_day": (F.col(v), False), "quietest_day": (F.col(v), True), "biggest_rise": (F.col("change"), False), "biggest_fall": (F.col("change"), True)}
    out = change.agg(F.count("*").alias("days"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.sum(v).alias("total_volume"), F.avg(v).alias("mean"), F.median(v).alias("median"), *[first(c, low).alias(n) for n, (c, low) in ends.items()])
    return out.select("days", "first_date", "last_date", "total_volume", "mean", "median", *[c for n in ends for c in (F.col(f"{n}.v").alias(n), F.col(f"{n}.d").alias(f"{n}_date"))])


def headline_metrics(*one_row: DataFrame) -> DataFrame:
    """One wide row from frames of one row each."""
    out = one_row[0]
    for df in one_row[1:]:
        out = out.crossJoin(df)
    return out


def matrix(df: DataFrame, row: Column, column: str, values: list, value: str, how: object = F.sum) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(how(value))
