"""Queries over written stores: wide detector-days, summaries, results and months that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core
from slotwise.plans.base import add
from slotwise.plans.profiles import _WIDE
from slotwise.sources import months, stores
from slotwise.sources.adapters import DETECTORS, MODES, to_observations

_MERGED = _WIDE + ", md AS (SELECT * FROM w WHERE v >= 0 QUALIFY row_number() OVER (PARTITION BY site_id, count_date, detector_id, interval_index ORDER BY source_priority) = 1)"


def source_summary(t):  # noqa: ANN001, ANN201
    """Values of each store, counted and added within the row, and the dates that have any."""
    wide = stores.require_columns(t.stored, ["site_id", "count_date", "detector_id", "counts", "source", "source_priority"])
    days = wide.select("source", "source_priority", "count_date", core.counts_count(F.col("counts")).alias("n"), core.counts_total(F.col("counts")).alias("v"))
    date = F.when(F.col("n") > 0, F.col("count_date"))
    return days.groupBy("source", "source_priority").agg(F.sum("n").alias("n_rows"), F.sum("v").alias("total_volume"), F.min(date).alias("first_date"), F.max(date).alias("last_date")).filter("n_rows > 0")


add(
    "stored_sources",
    source_summary,
    _WIDE + "SELECT source, source_priority, count(*) AS n_rows, sum(v)::BIGINT AS total_volume, min(count_date) AS first_date, max(count_date) AS last_date FROM w WHERE v >= 0 GROUP BY 1, 2",
)
add("stored_total_volume", lambda t: t.merged.agg(F.sum(core.counts_total(F.col("counts"))).alias("total_volume")), _MERGED + " SELECT sum(v)::BIGINT AS total_volume FROM md")
add("stored_daily_totals", lambda t: t.merged.groupBy("count_date").agg(F.sum(core.counts_total(F.col("counts"))).alias("day_total_volume")).filter("day_total_volume > 0"), _MERGED + " SELECT count_date, sum(v)::BIGINT AS day_total_volume FROM md GROUP BY 1 HAVING sum(v) > 0")
add(
    "stored_site_months",
    lambda t: t.merged.groupBy("site_id", C.month_label(F.col("count_date")).alias("month_label")).agg(F.sum(core.counts_total(F.col("counts"))).alias("v")).filter("v > 0"),
    _MERGED + " SELECT site_id, strftime(count_date, '%Y-%m') AS month_label, sum(v)::BIGINT AS v FROM md GROUP BY 1, 2 HAVING sum(v) > 0",
)
add("stored_slot_totals", lambda t: core.slots_by_bin(t.merged), _MERGED + " SELECT interval_index, sum(v)::BIGINT AS total_volume FROM md GROUP BY 1")


PERIODS = [("1996-03-12", "baseline"), ("1998-06-30", "shock"), ("2000-09-05", "recovery")]


def stored_periods(t):  # noqa: ANN001, ANN201
    """Chosen days out of the store: only their months' folders are read, and only those of their rows that several stores have are merged."""
    periods = t.spark.createDataFrame(PERIODS, "d string, period string").withColumn("d", F.to_date("d"))
    days = core.merge_overlaps(stores.on_dates(t.stored, [d for d, _ in PERIODS]), shared=t.shared)
    return days.join(F.broadcast(periods), days["count_date"] == periods["d"]).groupBy("period").agg(F.sum(core.counts_total(F.col("counts"))).alias("total_volume"), F.count("*").alias("detector_days"))


add(
    "stored_period_summary",
    stored_periods,
    _MERGED + ", per(d, period) AS (VALUES " + ", ".join(f"(DATE '{d}', '{p}')" for d, p in PERIODS) + "), dd AS (SELECT count_date, site_id, detector_id FROM w GROUP BY ALL), "
    "n AS (SELECT count_date, count(*) AS n FROM dd GROUP BY 1), v AS (SELECT count_date, sum(v)::BIGINT AS v FROM md GROUP BY 1) SELECT period, v AS total_volume, n AS detector_days FROM per JOIN n ON d = n.count_date LEFT JOIN v ON d = v.count_date",
)
add(
    "stored_window_totals",
    lambda t: core.between_dates(t.merged_by_month("1996-05-10", "1996-08-20"), "1996-05-10", "1996-08-20").groupBy("count_date").agg(F.sum(core.counts_total(F.col("counts"))).alias("day_total_volume")),
    _MERGED + ", dd AS (SELECT DISTINCT count_date FROM w WHERE count_date >= DATE '1996-05-10' AND count_date < DATE '1996-08-20') SELECT count_date, coalesce(sum(v), 0)::BIGINT AS day_total_volume FROM dd LEFT JOIN md USING (count_date) GROUP BY 1",
)
add(
    "clean_by_store",
    lambda t: core.dedup_observations(core.clean(t.raw_days, MODES), "priority").groupBy("count_date").agg(F.count("*").alias("n_rows"), F.count("volume_15m").alias("n_values"), F.sum("volume_15m").alias("v")),
    "SELECT count_date, count(*) AS n_rows, count(volume_15m) AS n_values, sum(volume_15m)::BIGINT AS v FROM (SELECT * REPLACE (CASE WHEN volume_15m >= 0 THEN volume_15m END AS volume_15m) FROM raw_days WHERE source <> 'main' OR volume_15m >= 0 "
    "QUALIFY row_number() OVER (PARTITION BY site_id, count_date, detector_id, interval_index ORDER BY source_priority, source_file_id) = 1) GROUP BY 1",
)
add(
    "merge_by_store",
    lambda t: core.merge_overlaps(t.stored, MODES, t.shared).select("site_id", "count_date", "detector_id", core.counts_total(F.col("counts")).alias("day_volume")),
    _WIDE + ", days AS (SELECT DISTINCT source, source_priority, site_id, count_date, detector_id FROM w), g AS (SELECT days.*, i::INTEGER AS interval_index FROM days, range(96) s(i)), "
    "x AS (SELECT g.*, v FROM g LEFT JOIN w USING (source, source_priority, site_id, count_date, detector_id, interval_index)), won AS (SELECT * FROM x WHERE source <> 'main' OR v >= 0 "
    "QUALIFY row_number() OVER (PARTITION BY site_id, count_date, detector_id, interval_index ORDER BY source_priority) = 1), s AS (SELECT site_id, count_date, detector_id, coalesce(sum(v) FILTER (v >= 0), 0)::BIGINT AS v FROM won GROUP BY ALL) "
    "SELECT site_id, count_date, detector_id, coalesce(v, 0) AS day_volume FROM (SELECT DISTINCT site_id, count_date, detector_id FROM days) LEFT JOIN s USING (site_id, count_date, detector_id)",
)


def summary_csv(t):  # noqa: ANN001, ANN201
    """Daily totals written as CSV with marker rows between, and read as text."""
    path = t.scratch("summary")
    marked = t.daily.select(F.col("count_date").cast("string").alias("count_date"), F.col("day_total_volume").cast("string").alias("day_total_volume")).union(t.daily.select(F.concat(F.lit("__DONE__"), F.date_format("count_date", "yyyy-MM")), F.lit("x")).distinct())
    stores.write_csv(marked, path)
    return stores.read_summary_csv(t.spark, path, t.daily.schema)


add("summary_csv", summary_csv, "SELECT * FROM daily")


def written(kind):  # noqa: ANN001, ANN201
    def make(t):  # noqa: ANN001, ANN202
        path = f"{t.scratch('result')}.{kind}"
        stores.write_result(t.daily, path)
        reader = t.spark.read.schema(t.daily.schema)
        return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)

    return make


for kind in ("csv", "json", "parquet"):
    add(f"written_{kind}", written(kind), "SELECT * FROM daily")


def nested_json(t):  # noqa: ANN001, ANN201
    """One record a site, with its place and its months inside."""
    path = t.scratch("sites")
    months = t.sm.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("month_label", "month_site_volume"))).alias("months"))
    stores.write_json(months.join(t.sites.select("site_id", "site_name", F.struct("latitude", "longitude").alias("place")), "site_id", "left"), path)
    read = t.spark.read.schema("site_id int, site_name string, place struct<latitude:double,longitude:double>, months array<struct<month_label:string,month_site_volume:bigint>>").json(path)
    return read.select("site_id", "site_name", "place.latitude", F.explode("months").alias("m")).select("site_id", "site_name", "latitude", "m.*")


add("nested_json", nested_json, "SELECT site_id, site_name, latitude, month_label, month_site_volume FROM sm LEFT JOIN sites USING (site_id)")


def refreshed(t):  # noqa: ANN001, ANN201
    """Months up to 1995 first, then all that are missing, then late counts of one month."""
    path = t.scratch("months")
    stores.refresh_months(t.daily.filter("count_date < '1996-01-01'"), path)
    stores.refresh_months(t.daily, path)
    late = t.daily.filter(C.month_label(F.col("count_date")) == "1996-05").withColumn("day_total_volume", F.col("day_total_volume") + 1)
    return stores.refresh_months(late, path, ["1996-05"])


add("refresh_months", refreshed, "SELECT count_date, day_total_volume + CASE WHEN strftime(count_date, '%Y-%m') = '1996-05' THEN 1 ELSE 0 END AS day_total_volume, strftime(count_date, '%Y-%m') AS month_label FROM daily")


def kept_by_manifest(t):  # noqa: ANN001, ANN201
    """Daily totals kept by month: built without some files of 1995, then with all (which rebuilds the months of the late files only), then once more (which rebuilds none)."""
    path = t.scratch("manifest")
    tasks = t.obs_tasks
    build = lambda rows: core.daily_totals(core.dedup_observations(rows, tasks=tasks))
    facts = core.clean(t.raw, "filter")
    months.refresh(facts.filter("count_date >= '1996-01-01' or source_file_id % 7 <> 0"), path, "source_file_id", build, tasks=tasks)
    late = months.refresh(facts, path, "source_file_id", build, tasks=tasks)
    if months.refresh(facts, path, "source_file_id", build, tasks=tasks):
        raise ValueError("months without new files were built again")
    return months.read(t.spark, path).withColumn("late", F.col("month_label").isin(late))


add(
    "refresh_by_manifest",
    kept_by_manifest,
    ", lt AS (SELECT DISTINCT strftime(count_date, '%Y-%m') AS l FROM raw WHERE volume_15m >= 0 AND count_date < DATE '1996-01-01' AND source_file_id % 7 = 0) SELECT count_date, day_total_volume, strftime(count_date, '%Y-%m') AS month_label, strftime(count_date, '%Y-%m') IN (SELECT l FROM lt) AS late FROM daily",
)


def runs(t):  # noqa: ANN001, ANN201
    """Site months of an older run over all, and of a newer one over the even sites."""
    older, newer = t.sm.withColumns({"epoch": F.lit(1), "month_site_volume": -F.col("month_site_volume")}), t.sm.filter("site_id % 2 = 0").withColumn("epoch", F.lit(2))
    return older.unionByName(newer)


add("latest_run", lambda t: stores.latest_run(runs(t), ["month_label"], "epoch"), "SELECT month_label, site_id, month_site_volume, 2 AS epoch FROM sm WHERE site_id % 2 = 0 UNION ALL SELECT month_label, site_id, -month_site_volume, 1 FROM sm WHERE month_label NOT IN (SELECT month_label FROM sm WHERE site_id % 2 = 0)")
add("latest_by_key", lambda t: stores.latest_by_key(runs(t), ["month_label", "site_id"], "epoch"), "SELECT month_label, site_id, CASE WHEN site_id % 2 = 0 THEN month_site_volume ELSE -month_site_volume END AS month_site_volume, CASE WHEN site_id % 2 = 0 THEN 2 ELSE 1 END AS epoch FROM sm")
add(
    "data_rows",
    lambda t: stores.data_rows(core.monthly_totals(t.day_bins, core.month_calendar(t.raw, extra=2))).select("month_label", "month_total_volume"),
    "SELECT * FROM monthly",
)
add(
    "to_observations",
    lambda t: to_observations(t.read("events").withColumns({"kind": C.first_match(*[(F.col("event_type") == k, v) for k, v in DETECTORS.items()]), "n": F.floor("value")}), "ts", "user_id", "kind", "n"),
    "SELECT user_id::INTEGER AS site_id, ts::DATE AS count_date, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS detector_id, (hour(ts) * 4 + minute(ts) // 15)::INTEGER AS interval_index, sum(floor(value))::BIGINT AS volume_15m FROM events GROUP BY 1, 2, 3, 4",
)
