"""Base cubes: clean, de-duplicated facts added up by (date, site) and by (date, slot), from which totals and profiles are read.

Both cubes come from one pass over the facts, so observations are dealt by their keys once for all results. A cube is as small as days times
sites, or days times 96; it is written by month, so a late month is rebuilt alone (``months.refresh``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import columns as C

SITE_DAYS, DAY_BINS = "site_days", "day_bins"
SCHEMA = "count_date date, site_id int, interval_index int, volume_15m bigint, n_rows bigint, cube string, month_label string"


def build(obs: DataFrame) -> DataFrame:
    """(cube, count_date, site_id, interval_index, volume_15m, n_rows): sums and numbers of rows, null rows counted but not added. A group of null volumes only has a null sum."""
    both = obs.groupingSets([["count_date", "site_id"], ["count_date", "interval_index"]], "count_date", "site_id", "interval_index")
    sums = both.agg(F.sum("volume_15m").alias("volume_15m"), F.count("*").alias("n_rows"), F.grouping("site_id").alias("by_bin"))
    return sums.select(F.when(F.col("by_bin") == 1, DAY_BINS).otherwise(SITE_DAYS).alias("cube"), "count_date", "site_id", "interval_index", "volume_15m", "n_rows")


def write(obs: DataFrame, path: str, tasks: int = 1, months: int = 1) -> None:
    """Both cubes, a folder a month. ``tasks`` (those that settled the observations) and the calendar's ``months`` bound what one task sorts: a month is parted by date and site among its share of the tasks."""
    cells = build(obs).withColumn("month_label", C.month_label(F.col("count_date")))
    share = F.pmod(F.hash("count_date", "site_id"), F.lit(-(-tasks // months)))
    dealt = cells.repartition(tasks, "month_label", share) if tasks > 1 else cells.hint("rebalance", "month_label")
    dealt.write.partitionBy("month_label").parquet(path)


def site_days(cells: DataFrame) -> DataFrame:
    """One row a date and site, to be used where observations are: volume_15m is the day's sum."""
    return cells.filter(F.col("cube") == SITE_DAYS).drop("cube", "interval_index")


def day_bins(cells: DataFrame) -> DataFrame:
    """One row a date and slot, to be used where observations are."""
    return cells.filter(F.col("cube") == DAY_BINS).drop("cube", "site_id").withColumn("time_bin", C.slot_to_time_bin(F.col("interval_index")))
