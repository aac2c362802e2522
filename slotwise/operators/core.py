"""Reshape, clean, de-duplicate, and the totals and profiles of the clean facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C

KEYS = ["site_id", "count_date", "detector_id", "interval_index"]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself; fails before any work if a column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def to_long(wide: DataFrame) -> DataFrame:
    """One row a slot from an array of 96 slots; no shuffle."""
    return wide.select("*", F.posexplode("slots").alias("interval_index", "volume_15m")).drop("slots").withColumn("time_bin", C.slot_to_time_bin(F.col("interval_index")))


def put_slots(counts: Column) -> Column:
    """An array of 96 slots from (slot, volume) pairs: put one after another into an array of nulls; several counts of a slot are added."""
    none = F.array_repeat(F.lit(None).cast("int"), 96)
    put = lambda a, c: F.concat(F.slice(a, 1, c["interval_index"]), F.array(F.coalesce(F.get(a, c["interval_index"]), F.lit(0)) + c["volume_15m"]), F.slice(a, c["interval_index"] + 2, 95 - c["interval_index"]))
    return F.aggregate(counts, none, put)


def add_counts(counts: Column) -> Column:
    """(slot, volume) pairs one a slot and by slot; several counts of a slot are added. Null counts as none."""
    slots = counts["interval_index"]
    total = lambda i: F.aggregate(F.filter(counts, lambda c: c["interval_index"] == i), F.lit(0), lambda s, c: s + c["volume_15m"])
    added = F.transform(F.sort_array(F.array_distinct(slots)), lambda i: F.struct(i.alias("interval_index"), total(i).alias("volume_15m")))
    return F.when(F.size(counts) == 1, counts).when(F.size(F.array_distinct(slots)) == F.size(counts), F.sort_array(counts)).otherwise(added)


def counts_to_slots(counts: Column) -> Column:
    """An array of 96 slots from what ``add_counts`` gives."""
    return F.when(F.size(counts) == 96, counts["volume_15m"]).otherwise(put_slots(counts))


def slots_to_counts(slots: Column) -> Column:
    """(slot, volume) pairs of the slots that are not null."""
    return F.filter(F.transform(slots, lambda v, i: F.struct(i.alias("interval_index"), v.cast("int").alias("volume_15m"))), lambda c: c["volume_15m"].isNotNull())


def clean(obs: DataFrame, mode: str | dict[str, str], volume: str = "volume_15m") -> DataFrame:
    """'filter' drops negative and null volumes; 'nullify' keeps the row and makes negatives null. A mapping names the mode of each ``source``; sources it leaves out are nullified."""
    kept = F.col(volume) >= 0
    if isinstance(mode, dict):
        return obs.filter(F.coalesce(kept, F.lit(False)) | ~_filtered(mode)).withColumn(volume, F.when(kept, F.col(volume)))
    if mode == "filter":
        return obs.filter(kept)
    if mode == "nullify":
        return obs.withColumn(volume, F.when(kept, F.col(volume)))
    raise ValueError(f"unknown mode {mode!r}")


def _filtered(modes: dict[str, str]) -> Column:
    """Whether a row's source is one of those in mode 'filter'."""
    if odd := set(modes.values()) - {"filter", "nullify"}:
        raise ValueError(f"unknown modes {sorted(odd)!r}")
    return F.coalesce(F.col("source").isin([n for n, m in modes.items() if m == "filter"]), F.lit(False))


def require_keys(obs: DataFrame) -> DataFrame:
    return obs.dropna(subset=KEYS)


def between_dates(df: DataFrame, first: str, end: str, date: str = "count_date") -> DataFrame:
    """Dates from ``first`` up to, without, ``end``. Of a table with ``month_label`` (as partitioned stores have), only those months are listed and read."""
    inside = (F.col(date) >= F.lit(first).cast("date")) & (F.col(date) < F.lit(end).cast("date"))
    if "month_label" in df.columns:
        inside &= F.col("month_label").between(first[:7], end[:7])
    return df.filter(inside)


_LAST, _NONE = (1 << 63) - 1, -(1 << 31) - 1
#: Observations that one task settles: its hash maps hold all of them.
PER_TASK = 300_000


def tasks_for(df: DataFrame, per_task: int | None = None) -> int:
    """Tasks among which the rows of ``df`` are dealt, so that one holds about ``per_task`` rows however large the table is; rows are counted."""
    return max(1, -(-df.count() // (per_task or PER_TASK)))


def dedup_observations(obs: DataFrame, order: str = "file", tasks: int | None = None) -> DataFrame:
    """One winner for each site, date, detector and slot: the smallest file id, or the smallest store priority; ties by the other.

    A null volume can win (policy first_row; drop nulls before for first_valid); a null file id or priority comes last (level with the largest long), and full ties go to
    the smaller volume, null first. Rows are dealt by key once; then three hash aggregations within the task settle the volume, the second and the first
    order column, so nothing is sorted and ids may be any long. Nulls of a key part are a value like others; drop them before (``require_keys``) where they are many.
    ``tasks`` go by the number of rows (``tasks_for``), which is counted where it is not given; Spark would join small partitions up to a size on disk that says little of the maps.
    """
    tasks = tasks_for(obs) if tasks is None else tasks
    first, second = ("source_file_id", "source_priority") if order == "file" else ("source_priority", "source_file_id")
    kinds = {c: obs.schema[c].dataType for c in (first, second, "volume_15m")}
    dealt = obs.select(*KEYS, *[F.coalesce(F.col(c).cast("long"), F.lit(_LAST)).alias(c) for c in (first, second)], F.coalesce(F.col("volume_15m").cast("long"), F.lit(_NONE)).alias("volume_15m"))
    dealt = dealt.repartition(tasks, *KEYS) if tasks > 1 else dealt.repartition(*KEYS)
    least = dealt.groupBy(*KEYS, first, second).agg(F.min("volume_15m").alias("volume_15m"))
    least = least.groupBy(*KEYS, first).agg(F.min_by("volume_15m", second).alias("volume_15m"), F.min(second).alias(second))
    won = least.groupBy(*KEYS).agg(F.min_by("volume_15m", first).alias("volume_15m"), F.min_by(second, first).alias(second), F.min(first).alias(first))
    known = {c: F.when(F.col(c) != (_NONE if c == "volume_15m" else _LAST), F.col(c)).cast(kinds[c]).alias(c) for c in kinds}
    return won.select(*KEYS, known["volume_15m"], *[known[c] for c in (first, second)])


def dedup_detector_days(wide: DataFrame) -> DataFrame:
    """One detector-day for each site, date and detector, by store priority, then file id: 96 times fewer rows than by slot."""
    keys = KEYS[:3]
    at = F.struct(F.col("source_priority").isNull(), "source_priority", F.col("source_file_id").isNull(), "source_file_id")
    rest = [c for c in wide.columns if c not in keys]
    return wide.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("w")).select(*keys, "w.*")


def merge_slots(wide: DataFrame, mode: str | dict[str, str] = "filter", tasks: int | None = None) -> DataFrame:
    """Slot by slot, the first store (by priority) that has a value: a detector-day of up to a few stores becomes one, with arrays only.

    A store in mode 'filter' counts where it has 0 or more; one in mode 'nullify' counts wherever it has the detector-day, and its null or negative slot hides later
    stores' values. ``mode`` is one for all or a mapping of ``source`` to mode; sources it leaves out are nullified. Detector-days are dealt by key, into ``tasks`` by their
    number (counted where it is not given), before they are listed: few of them meet in a file, and lists made there would hold all rows of a file.
    """
    tasks = tasks_for(wide) if tasks is None else tasks
    strict = _filtered(mode) if isinstance(mode, dict) else F.lit(mode == "filter")
    # a value counts, null is passed over, -1 is a null that counts
    codes = F.transform("slots", lambda v: F.when(v >= 0, v)), F.transform("slots", lambda v: F.when(v >= 0, v).otherwise(-1))
    coded = wide.select(*KEYS[:3], "source_priority", "source_file_id", F.when(strict, codes[0]).otherwise(codes[1]).alias("codes"))
    stores = F.array_sort(F.collect_list(F.struct("source_priority", "source_file_id", "codes")))
    dealt = coded.repartition(tasks, *KEYS[:3]) if tasks > 1 else coded.repartition(*KEYS[:3])
    merged = dealt.groupBy(*KEYS[:3]).agg(stores.alias("stores"))
    first = F.aggregate("stores", F.array_repeat(F.lit(None).cast("int"), 96), lambda a, s: F.zip_with(a, s["codes"], lambda x, y: F.coalesce(x, y)))
    # most detector-days lie in one store: their codes are the result, and nothing is folded
    only = F.when(F.size("stores") == 1, F.get("stores", F.lit(0))["codes"]).otherwise(first)
    return merged.select(*KEYS[:3], (only if mode == "filter" else F.transform(only, lambda v: F.when(v >= 0, v))).alias("slots"))


def merge_counts(stored: DataFrame, mode: str | dict[str, str] = "filter", tasks: int | None = None) -> DataFrame:
    """``merge_slots`` of detector-days that keep ``counts`` of their filled slots alone: those of the result, 0 or more.

    Rows are dealt by key and sorted once; a window lists each detector-day's stores in their order, and only those of several stores are looked into.
    """
    tasks = tasks_for(stored) if tasks is None else tasks
    hides = ~_filtered(mode) if isinstance(mode, dict) else F.lit(mode != "filter")
    coded = stored.select(*KEYS[:3], "source_priority", "source_file_id", F.filter("counts", lambda c: c["volume_15m"] >= 0).alias("counts"), hides.alias("hides"))
    dealt = coded.repartition(tasks, *KEYS[:3]) if tasks > 1 else coded.repartition(*KEYS[:3])
    ranked = Window.partitionBy(*KEYS[:3]).orderBy("source_priority", "source_file_id", "counts")
    all_of = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = dealt.select("*", F.collect_list(F.struct("counts", "hides")).over(all_of).alias("stores"), F.row_number().over(ranked).alias("_r")).filter("_r = 1")
    # of several stores: those up to the first that hides the rest; of each slot, the count of the first store
    seen = F.filter("stores", lambda s, i: ~F.exists(F.slice("stores", F.lit(1), i), lambda before: before["hides"]))
    tagged = F.flatten(F.transform(seen, lambda s, i: F.transform(s["counts"], lambda c: F.struct(c["interval_index"].alias("interval_index"), i.alias("store"), c["volume_15m"].alias("volume_15m")))))
    none = F.filter(F.transform("counts", lambda c: F.struct(c["interval_index"].alias("interval_index"), F.lit(0).alias("store"), c["volume_15m"].alias("volume_15m"))), lambda c: F.lit(False))
    # counts of a slot lie together after the sort; one is kept where the slot changes
    kept = F.aggregate(F.sort_array(tagged), none, lambda a, c: F.when(F.coalesce(F.get(a, F.size(a) - 1)["interval_index"] == c["interval_index"], F.lit(False)), a).otherwise(F.concat(a, F.array(c))))
    first = F.transform(kept, lambda c: F.struct(c["interval_index"].alias("interval_index"), c["volume_15m"].alias("volume_15m")))
    return listed.select(*KEYS[:3], F.when(F.size("stores") == 1, F.col("counts")).otherwise(first).alias("counts"))


def shared_dates(wide: DataFrame) -> DataFrame:
    """Dates that two stores or more have, read from the dates and priorities alone; at most as many as the calendar has."""
    return wide.groupBy("count_date").agg(F.min("source_priority").alias("a"), F.max("source_priority").alias("b")).filter("a <> b").select("count_date")


def merge_overlaps(wide: DataFrame, mode: str | dict[str, str] = "filter", shared: DataFrame | None = None) -> DataFrame:
    """Detector-days of one store a date stay as they are, cleaned within the row and not shuffled; only dates that two stores or more have are merged (``merge_slots``).

    A store has a detector-day once. ``shared`` gives the shared dates where they are known or written down; they are as few as the calendar's days, so they are broadcast.
    A table with ``counts`` (as ``stores.read_stores`` gives) is merged by them, and the result has ``counts`` beside ``slots``, which cost nothing where they are not asked for.
    """
    shared = F.broadcast(shared_dates(wide) if shared is None else shared)
    alone, several = wide.join(shared, "count_date", "left_anti"), wide.join(shared, "count_date", "left_semi")
    if "counts" in wide.columns:
        own = alone.select(*KEYS[:3], F.filter("counts", lambda c: c["volume_15m"] >= 0).alias("counts"))
        return own.unionByName(merge_counts(several, mode, tasks_for(wide))).withColumn("slots", counts_to_slots(F.col("counts")))
    own = alone.select(*KEYS[:3], F.transform("slots", lambda v: F.when(v >= 0, v)).alias("slots"))
    return own.unionByName(merge_slots(several, mode, tasks_for(wide)))


def slots_by_bin(wide: DataFrame, *keys: str) -> DataFrame:
    """Total of each slot for any keys: values only are exploded, so empty slots cost no rows."""
    filled = F.filter(F.transform("slots", lambda v, i: F.struct(i.alias("interval_index"), v.alias("v"))), lambda s: s["v"] >= 0)
    return wide.select(*keys, F.explode(filled).alias("s")).groupBy(*keys, F.col("s.interval_index").alias("interval_index")).agg(F.sum("s.v").alias("total_volume"))


def slots_count(slots: Column) -> Column:
    """How many slots of a detector-day have a non-negative value, within the row."""
    return F.size(F.filter(slots, lambda v: v >= 0))


def slots_total(slots: Column) -> Column:
    """Sum of the non-negative slots of a detector-day, within the row."""
    return F.aggregate(slots, F.lit(0).cast("bigint"), lambda s, v: s + F.when(v >= 0, v).otherwise(0))


def counts_count(counts: Column) -> Column:
    """``slots_count`` of a detector-day that keeps its filled slots alone."""
    return F.size(F.filter(counts, lambda c: c["volume_15m"] >= 0))


def counts_total(counts: Column) -> Column:
    """``slots_total`` of a detector-day that keeps its filled slots alone."""
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, c: s + F.when(c["volume_15m"] >= 0, c["volume_15m"]).otherwise(0))


def daily_totals(obs: DataFrame) -> DataFrame:
    return obs.groupBy("count_date").agg(F.sum("volume_15m").alias("day_total_volume")).filter("day_total_volume is not null")


def site_totals(obs: DataFrame) -> DataFrame:
    return obs.groupBy("site_id").agg(F.sum("volume_15m").alias("total_volume"))


def site_month_totals(obs: DataFrame) -> DataFrame:
    return obs.groupBy(C.month_label(F.col("count_date")).alias("month_label"), "site_id").agg(F.sum("volume_15m").alias("month_site_volume"))


def month_calendar(df: DataFrame, date: str = "count_date", extra: int = 0) -> DataFrame:
    """Every month from the first date to the last (and ``extra`` more)."""
    ends = df.agg(F.trunc(F.min(date), "month").alias("a"), F.add_months(F.trunc(F.max(date), "month"), extra).alias("b"))
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month_start"))
    return months.select(C.month_label(F.col("month_start")).alias("month_label"), "month_start", F.add_months("month_start", 1).alias("next_month_start"))


def monthly_totals(obs: DataFrame, calendar: DataFrame) -> DataFrame:
    """Total of every month of the calendar; an empty month has 0 and row_type zero_row_month."""
    found = obs.groupBy(C.month_label(F.col("count_date")).alias("month_label")).agg(F.sum("volume_15m").alias("t"))
    return calendar.join(found, "month_label", "left").select("month_label", "month_start", "next_month_start", F.coalesce("t", F.lit(0)).alias("month_total_volume"), F.when(F.col("t").isNull(), "zero_row_month").otherwise("data").alias("row_type"))


def profile(obs: DataFrame, **keys: Column) -> DataFrame:
    """Total, distinct dates with a value, and total a day, for any calendar keys. Volumes are first added by date, so dates are counted once."""
    dated = obs.groupBy("count_date", *[c.alias(k) for k, c in keys.items()]).agg(F.sum("volume_15m").alias("v"))
    out = dated.groupBy(*keys).agg(F.sum("v").alias("total_volume"), F.count("v").alias("days_loaded"))
    return out.withColumn("avg_daily_volume", C.safe_div(F.col("total_volume"), F.col("days_loaded")))


def weekday_weekend(obs: DataFrame, *keys: Column) -> DataFrame:
    """Weekday and weekend volumes and days, for each of ``keys``."""
    dated = obs.groupBy("count_date").agg(F.sum("volume_15m").alias("v")).filter("v is not null")
    weekend = C.iso_dow(F.col("count_date")) >= 6
    return dated.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~weekend, F.col("v"))), F.lit(0)).alias("weekday_volume"), F.coalesce(F.sum(F.when(weekend, F.col("v"))), F.lit(0)).alias("weekend_volume"),
        F.count_if(~weekend).alias("weekday_days"), F.count_if(weekend).alias("weekend_days"),
    )


def peak_shares(obs: DataFrame, *keys: Column) -> DataFrame:
    """AM (07-10) and PM (16-19) volumes and their shares."""
    am, pm = ((F.col("time_bin") >= a) & (F.col("time_bin") < b) for a, b in (("07:00", "10:00"), ("16:00", "19:00")))
    v = F.col("volume_15m")
    out = obs.groupBy(*keys).agg(F.sum(v).alias("total_volume"), F.sum(F.when(am, v).otherwise(0)).alias("am_volume"), F.sum(F.when(pm, v).otherwise(0)).alias("pm_volume"))
    return out.withColumns({"am_share_pct": C.pct(F.col("am_volume"), F.col("total_volume")), "pm_share_pct": C.pct(F.col("pm_volume"), F.col("total_volume"))})


def day_part_shares(obs: DataFrame) -> DataFrame:
    t, v = F.col("time_bin"), F.col("volume_15m")
    parts = {"am_peak": (t >= "07:00") & (t < "10:00"), "pm_peak": (t >= "16:00") & (t < "19:00"), "overnight": t < "06:00", "before_9am": t < "09:00", "after_6pm": t >= "18:00"}
    out = obs.agg(F.sum(v).alias("total_volume"), *[F.sum(F.when(p, v).otherwise(0)).alias(k) for k, p in parts.items()])
    return out.withColumns({f"{k}_pct": F.round(C.pct(F.col(k), F.col("total_volume")), 2) for k in parts})


def top(df: DataFrame, n: int, metric: str, tie: str, rank: str = "rank", asc: bool = False) -> DataFrame:
    """The first n rows by ``metric`` (nulls last), ties by ``tie``, with their rank. Spark keeps n rows a task, so nothing is sorted whole."""
    order = [F.col(metric).asc_nulls_last() if asc else F.col(metric).desc_nulls_last(), F.col(tie).asc_nulls_last()]
    few = df.orderBy(*order).limit(n)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def semi_top(obs: DataFrame, n: int, key: str = "site_id") -> DataFrame:
    """Observations of the n sites with the largest totals. The key list is at most n rows, so it is broadcast."""
    keys = top(obs.groupBy(key).agg(F.sum("volume_15m").alias("t")), n, "t", key).select(key)
    return obs.join(F.broadcast(keys), key, "left_semi")


def best(df: DataFrame, metric: str, tie: str, asc: bool = False) -> DataFrame:
    return top(df, 1, metric, tie, "_r", asc).drop("_r")


def top_per_group(df: DataFrame, group: str, metric: str, tie: str, n: int = 1, asc: bool = False) -> DataFrame:
    order = [F.col(metric).asc_nulls_last() if asc else F.col(metric).desc_nulls_last(), F.col(tie).asc_nulls_last()]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
