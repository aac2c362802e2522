"""Data-quality audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C

#: Numbers that stand for a missing count.
SENTINELS = [-1, -2, -3, -4, -5, -9, -99, -999]


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(n)) for n, df in tables.items()])


def null_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, nulls), in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.unpivot([], names, "column_name", "nulls")


def distinct_counts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row: distinct values of each column. Each is counted from its column alone, combined map-side; counted together, every row would be copied once a column."""
    counts = [df.groupBy(c).agg(F.lit(1)).agg(F.count(c).alias(n)) for c, n in names.items()]
    return reduce(DataFrame.crossJoin, counts)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def duplicate_excess(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_excess"))


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """By store: keys that repeat, their rows, the largest group."""
    return duplicate_groups(df, ["source", *keys]).groupBy("source").agg(F.count("*").alias("duplicate_keys"), F.sum("n_rows").alias("duplicate_rows"), F.max("n_rows").alias("largest"))


def slot_range(obs: DataFrame) -> DataFrame:
    i = F.col("interval_index")
    return obs.agg(F.min(i).alias("min_slot"), F.max(i).alias("max_slot"), F.count_if(i.isNull() | ~i.between(0, 95)).alias("bad_rows"))


def volume_distribution(obs: DataFrame) -> DataFrame:
    v = F.col("volume_15m")
    return obs.agg(F.min(v).alias("min_volume"), F.max(v).alias("max_volume"), F.count_if(v < 0).alias("negative_rows"), F.count_if(v == 0).alias("zero_rows"), F.count_if(v > 0).alias("positive_rows"), F.count_if(v.isNull()).alias("null_rows"))


def negatives_by(obs: DataFrame, key: str) -> DataFrame:
    return obs.filter("volume_15m < 0").groupBy(key).agg(F.count("*").alias("negative_rows"))


def raw_vs_clean(obs: DataFrame, *keys: str) -> DataFrame:
    v = F.col("volume_15m")
    out = obs.groupBy(*keys).agg(F.sum(v).alias("raw_volume"), F.sum(F.when(v >= 0, v)).alias("clean_volume"), F.count_if(v < 0).alias("negative_rows"))
    return out.withColumn("gap", F.col("clean_volume") - F.col("raw_volume"))


def missing_dates(df: DataFrame) -> DataFrame:
    ends = df.agg(F.min("count_date").alias("a"), F.max("count_date").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("count_date")).join(df.select("count_date").distinct(), "count_date", "left_anti")


def coverage_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, dates, months, sites, detectors (site and number) and volume of each key. Rows are first added by key, date, site and detector, so that distinct counts run over far fewer."""
    small = df.groupBy(*keys, "count_date", "site_id", "detector_id").agg(F.count("*").alias("n"), F.sum("volume_15m").alias("v"))
    return small.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.countDistinct("count_date").alias("dates"), F.countDistinct(C.month_label(F.col("count_date"))).alias("months"), F.countDistinct("site_id").alias("sites"), F.countDistinct("site_id", "detector_id").alias("detectors"), F.sum("v").alias("total_volume"))


def coverage_state(df: DataFrame, *keys: str, per_site: int = 1024) -> DataFrame:
    """Mergeable coverage of each key: rows (dim 'rows': n, v) and exact sets of dates, sites and detectors as bitmaps of 32,768 numbers (dim, bucket, bits).

    States add up over keys (``merge_coverage``), so a level of any other grouping needs no second pass over the facts. Facts are first added up by key, date, site and detector, so only those
    rows are copied once a set. Detector numbers must be under ``per_site``; others raise. A null date, site or detector is in no set.
    """
    number = F.col("detector_id").cast("long")
    fits = number.isNull() | number.between(0, per_site - 1)
    pair = F.when(fits, F.col("site_id").cast("long") * per_site + number).otherwise(F.raise_error(F.concat(F.lit("detector number out of range: "), number.cast("string"))).cast("long"))
    small = df.groupBy(*keys, "count_date", "site_id", "detector_id").agg(F.count("*").alias("n"), F.sum("volume_15m").alias("v"))
    sets = {"dates": F.unix_date("count_date").cast("long"), "sites": F.col("site_id").cast("long"), "detectors": pair}
    none = F.lit(None).cast("long")
    cells = [F.struct(F.lit("rows").alias("dim"), none.alias("x"), F.col("n").alias("n"), F.col("v").cast("long").alias("v"))]
    cells += [F.struct(F.lit(name).alias("dim"), x.alias("x"), none.alias("n"), none.alias("v")) for name, x in sets.items()]
    flat = small.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*").withColumn("bucket", F.bitmap_bucket_number("x"))
    return flat.groupBy(*keys, "dim", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"), F.sum("n").alias("n"), F.sum("v").alias("v"))


def merge_coverage(state: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """(level, key, n_rows, dates, sites, detectors, total_volume) of every level at once; a level is a text made of the state's keys. Sets are united bitmap by bitmap, then counted."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("level"), key.alias("key")) for name, key in levels.items()]))
    united = state.select(each.alias("l"), "dim", "bucket", "bits", "n", "v").groupBy("l.level", "l.key", "dim", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"), F.sum("v").alias("v"))
    counted = lambda name: F.coalesce(F.sum(F.when(F.col("dim") == name, F.bitmap_count("bits"))), F.lit(0)).alias(name)
    return united.groupBy("level", "key").agg(F.sum("n").alias("n_rows"), *[counted(n) for n in ("dates", "sites", "detectors")], F.sum("v").alias("total_volume"))


def file_usage(df: DataFrame) -> DataFrame:
    return df.groupBy("source_file_id").agg(F.count("*").alias("n_rows"), F.min("count_date").alias("first_date"), F.max("count_date").alias("last_date"), F.countDistinct("site_id").alias("sites"))


def slot_quality(wide: DataFrame, *keys: str) -> DataFrame:
    """Null, negative and sentinel counts of each slot over detector-days. Only values are exploded; nulls are what the detector-days lack of 96 values each."""
    v = F.col("s.v")
    days = wide.groupBy(*keys).agg(F.count("*").alias("detector_days")).withColumn("interval_index", F.explode(F.sequence(F.lit(0), F.lit(95))))
    filled = F.filter(F.transform("slots", lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda s: s["v"].isNotNull())
    found = wide.select(*keys, F.explode(filled).alias("s")).groupBy(*keys, F.col("s.i").alias("interval_index")).agg(F.count("*").alias("n"), F.count_if(v < 0).alias("neg"), F.count_if(v.isin(SENTINELS)).alias("sen"))
    none = lambda c: F.coalesce(c, F.lit(0))
    out = days.join(found, [*keys, "interval_index"], "left").select(*keys, "interval_index", "detector_days", (F.col("detector_days") - none("n")).alias("null_count"), none("neg").alias("negative_count"), none("sen").alias("sentinel_count"))
    return out.withColumns({"time_bin": C.slot_to_time_bin(F.col("interval_index")), "coverage_pct": C.pct(F.col("detector_days") - F.col("null_count"), F.col("detector_days"))})


def monthly_quality(obs: DataFrame) -> DataFrame:
    """Rows, days, sites and volumes of each month; z of its rows among all months, flagged where it is under -2 or over 2."""
    day = obs.groupBy(C.month_label(F.col("count_date")).alias("month_label"), "count_date", "site_id").agg(F.count("*").alias("n"), F.sum("volume_15m").alias("s"), F.count("volume_15m").alias("k"), F.min("volume_15m").alias("lo"), F.max("volume_15m").alias("hi"))
    out = day.groupBy("month_label").agg(
        F.sum("n").alias("n_rows"), F.countDistinct("count_date").alias("days_present"), F.countDistinct("site_id").alias("distinct_sites"), F.sum("s").alias("total_volume"), C.safe_div(F.sum("s"), F.sum("k")).alias("mean_volume"), F.min("lo").alias("min_volume"), F.max("hi").alias("max_volume")
    )
    all_rows = Window.partitionBy()
    z = C.safe_div(F.col("n_rows") - F.avg("n_rows").over(all_rows), F.stddev_samp("n_rows").over(all_rows))
    return out.withColumn("rows_zscore", F.coalesce(z, F.lit(0.0))).withColumns({"low_row_count": F.col("rows_zscore") < -2, "high_row_count": F.col("rows_zscore") > 2})


def detector_stability(obs: DataFrame) -> DataFrame:
    days = obs.select("site_id", "detector_id", "count_date").distinct().groupBy("site_id", "detector_id").agg(F.count("*").alias("d"))
    return days.agg(F.count("*").alias("detectors"), F.avg("d").alias("mean_days"), F.percentile("d", F.lit(0.5)).alias("median_days"), F.max("d").alias("max_days"), F.min("d").alias("min_days"))


def month_audit(obs: DataFrame, calendar: DataFrame, unavailable: list[str], final: str) -> DataFrame:
    """Each month of the calendar: the stores that have it, rows and volume, whether it is detected or known to be unavailable, and a status; ``final`` is the audit's last, partial month."""
    stores = obs.groupBy(C.month_label(F.col("count_date")).alias("month_label")).agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source").alias("source_count"), F.count("*").alias("n_rows"), F.sum("volume_15m").alias("total_volume")
    )
    m, found = F.col("month_label"), F.coalesce(F.col("source_count") > 0, F.lit(False))
    status = C.first_match(((m == final) & found, "Detected partial final month"), (m.isin(unavailable), "Known unavailable"), (found, "Detected"), otherwise="Missing")
    return calendar.select("month_label").join(stores, "month_label", "left").select(
        "month_label", F.substring(m, 1, 4).cast("int").alias("year"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "n_rows", "total_volume",
        found.alias("detected"), m.isin(unavailable).alias("known_unavailable"), status.alias("status"),
    )


def year_audit(months: DataFrame, final_year: int) -> DataFrame:
    """Months of each year: expected, detected, known to be unavailable, valid (detected less unavailable) and missing without a reason; rows and volume; whether the audit ends within it."""
    out = months.groupBy("year").agg(F.count("*").alias("expected_months"), F.count_if("detected").alias("detected_months"), F.count_if("known_unavailable").alias("known_unavailable_months"), F.sum("n_rows").alias("n_rows"), F.sum("total_volume").alias("total_volume"))
    expected, detected, known = (F.col(f"{n}_months") for n in ("expected", "detected", "known_unavailable"))
    return out.withColumns({"valid_months_detected": detected - known, "missing_unexplained_months": expected - detected - known, "is_partial_year": F.col("year") == final_year})


def unified_summary(obs: DataFrame) -> DataFrame:
    v = F.col("volume_15m")
    return obs.groupBy(C.month_label(F.col("count_date")).alias("month_label")).agg(F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("null_rows"), F.count_if(v < 0).alias("negative_rows"), F.countDistinct("count_date").alias("dates"))


def audit_verdict(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(check_name, value, ok): slots, negatives, missing dates, repeated keys."""
    parts = [
        slot_range(obs).select(F.lit("bad_slots").alias("check_name"), F.col("bad_rows").alias("value")),
        volume_distribution(obs).select(F.lit("negative_rows").alias("check_name"), F.col("negative_rows").alias("value")),
        missing_dates(obs).agg(F.count("*").alias("value")).withColumn("check_name", F.lit("missing_dates")),
        duplicate_excess(obs, keys).select(F.lit("duplicate_excess").alias("check_name"), F.col("duplicate_excess").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("value") == 0)
