"""Map-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core
from slotwise.operators import sites as S


def pulse(obs: DataFrame, dates: list[str]) -> DataFrame:
    """Volume by site, date and time of chosen days."""
    return obs.filter(F.col("count_date").isin(*[F.lit(d).cast("date") for d in dates])).groupBy("site_id", "count_date", "time_bin").agg(F.sum("volume_15m").alias("volume"))


#: Bands of intensity, from the quantile at which each begins.
BANDS = [(0.98, "extreme"), (0.90, "very high"), (0.75, "high"), (0.50, "medium")]


def scaled(rows: DataFrame, *keys: str) -> DataFrame:
    """With ``scaled_volume`` (log1p), ``scaled_volume_0_100`` (its share of the largest, in per cent) and ``intensity_band`` (by quantiles of the volume), over all rows or by ``keys``."""
    cuts = rows.groupBy(*keys).agg(F.log1p(F.max("volume")).alias("_top"), F.percentile("volume", F.array(*[F.lit(q) for q, _ in BANDS])).alias("_q"))
    joined = rows.join(cuts, list(keys)) if keys else rows.crossJoin(F.broadcast(cuts))
    v, log = F.col("volume"), F.log1p("volume")
    band = C.first_match(*[(v >= F.col("_q")[i], name) for i, (_, name) in enumerate(BANDS)], otherwise="low")
    share = F.when(F.col("_top") > 0, log / F.col("_top") * 100).otherwise(0.0)
    return joined.withColumns({"scaled_volume": log, "scaled_volume_0_100": share, "intensity_band": band}).drop("_top", "_q")


def enrich_pulse(rows: DataFrame, sites: DataFrame, least: int = 1, *keys: str) -> DataFrame:
    """With place, time stamp and its labels, log scale and band (``scaled``, by ``keys``); rows under ``least`` and sites without place are left out before anything is scaled."""
    placed = rows.filter(F.col("volume") >= least).join(sites.filter("latitude is not null and longitude is not null").select("site_id", "site_name", "latitude", "longitude"), "site_id")
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.col("count_date").cast("string"), F.col("time_bin")), F.lit("yyyy-MM-dd HH:mm"))
    timed = placed.withColumn("timestamp", stamp).filter("timestamp is not null")
    labels = {"hour": F.hour("timestamp"), "minute": F.minute("timestamp"), "time_label": F.date_format("timestamp", "HH:mm"), "date_label": F.date_format("timestamp", "yyyy-MM-dd"), "day_name": F.date_format("timestamp", "EEEE")}
    return scaled(timed.withColumns(labels), *keys)


#: Fixed value: the day on which the animation of compared days begins.
ANIMATION_START = "2030-01-01"


def comparison_pulse(rows: DataFrame, sites: DataFrame, least: int = 1) -> DataFrame:
    """Compared days (``period``, ``sequence`` from 0) one after another on a clock of their own; each day is scaled by itself."""
    pulses = rows.groupBy("period", "sequence", "site_id", "count_date", "time_bin").agg(F.sum("volume_15m").alias("volume"))
    full = enrich_pulse(pulses, sites, least, "sequence")
    clock = F.timestamp_add("MINUTE", (F.col("sequence") * 1440 + F.col("hour") * 60 + F.col("minute")).cast("int"), F.lit(ANIMATION_START).cast("timestamp"))
    return full.select(
        clock.alias("animation_timestamp"), "timestamp", "date_label", F.col("sequence").alias("comparison_sequence"), F.col("period").alias("comparison_period"), "time_label", "hour", "minute",
        "site_id", "site_name", "latitude", "longitude", "volume", "scaled_volume", "scaled_volume_0_100", "intensity_band",
    )


#: The box in which sites of the seasonal map lie (south, north, west, east), and how many sites it shows.
SEASONAL_BOX, SEASONAL_SITES = (-39.5, -36.0, 143.0, 146.5), 100


def seasonal_pulse(sm: DataFrame, sites: DataFrame, n: int = SEASONAL_SITES, least: int = 1) -> DataFrame:
    """Months of the ``n`` sites with the largest totals (then those with a place in the box), with season and scale."""
    months = sm.filter(F.col("month_site_volume") >= least)
    totals = months.groupBy("site_id").agg(F.sum("month_site_volume").alias("site_total_volume"))
    ranked = core.top(totals, n, "site_total_volume", "site_id", "site_rank")
    south, north, west, east = SEASONAL_BOX
    placed = sites.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east)).select("site_id", "site_name", "latitude", "longitude")
    rows = months.join(F.broadcast(ranked), "site_id").join(placed, "site_id").withColumnRenamed("month_site_volume", "volume")
    start = F.to_date(F.concat("month_label", F.lit("-01")))
    dated = rows.withColumns({"animation_timestamp": start, "month_start": start, "year": F.year(start), "month_of_year": F.month(start), "month_name": F.date_format(start, "MMMM"), "seasonal_band": C.season(F.month(start))})
    return scaled(dated)


def am_pm(rows: DataFrame, shift: float = 0.5) -> DataFrame:
    """Morning and evening peaks side by side: the morning's longitude is shifted west, the evening's east."""
    t = F.col("time_bin")
    part = C.first_match(((t >= "07:00") & (t < "10:00"), "AM Peak 07:00-10:00"), ((t >= "16:00") & (t < "19:00"), "PM Peak 16:00-19:00"))
    return rows.withColumn("peak_period", part).filter("peak_period is not null").withColumns({"comparison_longitude": F.col("longitude") + F.when(F.col("peak_period").startswith("AM"), -shift).otherwise(shift), "comparison_latitude": F.col("latitude")})


def overnight(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("time_bin") < "05:00")


def map_link(latitude: Column, longitude: Column) -> Column:
    return F.format_string("https://www.google.com/maps?q=%.6f,%.6f", latitude, longitude)


# Search links and exposure texts.
SEARCH = "https://www.google.com/maps/search/?api=1&query="
NO_TOTAL = "Traffic total not matched; parcel enrichment is available but exposure metrics require a matching site total."


def search_link(latitude: Column, longitude: Column, site: Column, name: Column) -> Column:
    """A map search for the place, or for the site's number and name where the place is not known."""
    place = F.concat(latitude.cast("string"), F.lit(","), longitude.cast("string"))
    words = F.replace(F.concat(F.lit("SCATS "), site.cast("string"), F.lit(" "), name, F.lit(" Victoria")), F.lit(" "), F.lit("%20"))
    return F.concat(F.lit(SEARCH), F.when(latitude.isNotNull() & longitude.isNotNull(), place).otherwise(words))


def exposure_text(total: Column, annual: Column, daily: Column, peak: Column, period: str) -> Column:
    """A sentence on a site's total and what it is a year, a day and in the peak hour."""
    whole = lambda c: F.format_number(c, 0)
    said = F.concat(whole(total), F.lit(f" vehicle movements across {period}; approximately "), whole(annual), F.lit(" per year, "), whole(daily), F.lit(" per day, and an indicative "), whole(peak), F.lit(" vehicles in a major peak hour."))
    return F.when(F.coalesce(total, F.lit(0)) <= 0, NO_TOTAL).otherwise(said)


def site_map(site_totals: DataFrame, sites: DataFrame) -> DataFrame:
    """One record a site, by rank of its total: name, place if known, percentile, band, ratio to the largest, and a search link for every site."""
    banded = S.traffic_band(site_totals).join(sites.select("site_id", "site_name", "municipality", "latitude", "longitude"), "site_id", "left")
    named = banded.withColumn("friendly_name", C.friendly_name(F.col("site_name"), F.col("site_id")))
    return named.select(
        F.row_number().over(Window.orderBy(F.desc("total_volume"), "site_id")).alias("rank"), "site_id", "friendly_name", F.coalesce("site_name", F.lit("")).alias("site_name"), "municipality", F.col("total_volume").alias("total_cleaned_volume"),
        "latitude", "longitude", (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("has_coordinates"), F.col("volume_percentile").alias("percentile_rank"), F.col("volume_band").alias("traffic_band"),
        F.round("ratio_to_max", 6).alias("volume_ratio"), search_link(F.col("latitude"), F.col("longitude"), F.col("site_id"), F.col("friendly_name")).alias("google_maps_url"),
    )
