"""Small cases of cleaning, dedup, calendars and windows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core, trends
from slotwise.operators import exports, profiles, sites
from slotwise.sources import cubes, months, stores

SCHEMA = "site_id int, count_date date, detector_id int, interval_index int, volume_15m int, source_file_id long, source string, source_priority int"
D = dt.date(2024, 1, 1)


def obs(spark, *rows):
    return spark.createDataFrame([(1, D, 1, s, v, f, n, p) for s, v, f, n, p in rows], SCHEMA)


def test_clean_modes(spark):
    df = obs(spark, *[(0, v, i, "main", 2) for i, v in enumerate((-1022, -1, 0, 5, None))])
    assert sorted(r[0] for r in core.clean(df, "filter").select("volume_15m").collect()) == [0, 5]
    assert [r[0] for r in core.clean(df, "nullify").orderBy("source_file_id").select("volume_15m").collect()] == [None, None, 0, 5, None]
    with pytest.raises(ValueError):
        core.clean(df, "other")


def test_dedup_policies_and_ties(spark):
    df = obs(spark, (0, -5, 1, "main", 2), (0, 7, 2, "cont", 3), (1, 3, 9, "cont", 3), (1, 4, 9, "rec", 1))
    first_row = core.dedup_observations(core.clean(df, "nullify"))
    assert {(r.interval_index, r.volume_15m) for r in first_row.collect()} == {(0, None), (1, 4)}
    first_valid = core.dedup_observations(core.clean(df, "filter"))
    assert {(r.interval_index, r.volume_15m) for r in first_valid.collect()} == {(0, 7), (1, 4)}
    again = core.dedup_observations(first_valid.withColumn("x", F.lit(1)).repartition(16))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first_valid.collect()))


def test_merge_slots_equals_slot_dedup(spark):
    slots = lambda **v: [v.get(f"s{i}") for i in range(96)]
    wide = spark.createDataFrame([(1, D, 1, 2, 5, slots(s0=-5, s1=3)), (1, D, 1, 1, 6, slots(s0=9, s2=-1))], "site_id int, count_date date, detector_id int, source_priority int, source_file_id long, slots array<int>")
    merged = core.merge_slots(wide).select("slots").first()[0]
    assert merged[:3] == [9, 3, None] and core.merge_slots(wide).select(core.slots_total(F.col("slots"))).first()[0] == 12


def test_empty_month_is_zero(spark):
    df = obs(spark, (0, 5, 1, "main", 2)).union(obs(spark, (0, 6, 1, "main", 2)).withColumn("count_date", F.lit("2024-03-05").cast("date")))
    rows = {r.month_label: (r.month_total_volume, r.row_type) for r in core.monthly_totals(df, core.month_calendar(df)).collect()}
    assert rows == {"2024-01": (5, "data"), "2024-02": (0, "zero_row_month"), "2024-03": (6, "data")}


def test_text_helpers(spark):
    df = spark.createDataFrame([("07:00:00",), ("7",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(C.time_bin_to_minutes(F.col("t"))).collect()] == [420, 105, None, None]
    ids = spark.createDataFrame([("4415.0",), ("Site 4415",), ("",), (None,)], "t string")
    assert [r[0] for r in ids.select(C.clean_site_id(F.col("t"))).collect()] == [4415, 4415, None, None]


def test_pct_rank_and_rolling(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, None)], "i int, v int")
    assert [r[0] for r in df.withColumn("p", C.pct_rank(F.col("v"))).orderBy("i").select("p").collect()] == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3, None])
    assert [r[0] for r in trends.rolling_mean(df, "i", "v", 3, 2, "m").orderBy("i").select("m").collect()] == pytest.approx([None, 15, 50 / 3, 20])


def test_partial_tail(spark):
    months = [(f"2024-{m:02d}", 100) for m in range(1, 9)]
    df = lambda rows: spark.createDataFrame(rows, "month_label string, month_total_volume long")
    assert trends.drop_partial_tail(df([*months, ("2024-09", 50)])).count() == 8
    assert trends.drop_partial_tail(df([*months[:7], ("2024-08", 50)])).count() == 8


def test_refresh_months(spark, tmp_path):
    path = str(tmp_path / "t")
    one = obs(spark, (0, 5, 1, "main", 2))
    assert stores.refresh_months(one, path).count() == 1
    both = one.union(one.withColumn("count_date", F.lit("2024-02-01").cast("date")))
    assert stores.refresh_months(both, path).count() == 2
    late = stores.refresh_months(both.withColumn("volume_15m", F.lit(9)), path, ["2024-02"])
    assert {(r.month_label, r.volume_15m) for r in late.collect()} == {("2024-01", 5), ("2024-02", 9)}


def test_summary_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("scats_site,v\n1,5\n__ZERO__,0\n2,x\n")
    schema = spark.createDataFrame([], "scats_site int, v long").schema
    assert sorted(map(tuple, stores.read_summary_csv(spark, str(tmp_path / "a.csv"), schema).collect()), key=str) == [(1, 5), (2, None)]


def test_merge_overlaps_equals_merge_of_all(spark):
    slots = lambda **v: [v.get(f"s{i}") for i in range(96)]
    other = dt.date(2024, 1, 2)
    rows = [(1, D, 1, 2, 5, slots(s0=-5, s1=3)), (1, D, 1, 1, 6, slots(s0=9, s2=-1)), (2, D, 1, 2, 7, slots(s4=4)), (1, other, 1, 2, 8, slots(s0=-5, s1=2, s95=7))]
    wide = spark.createDataFrame(rows, "site_id int, count_date date, detector_id int, source_priority int, source_file_id long, slots array<int>")
    one, other_way = (sorted(map(str, d.collect())) for d in (core.merge_overlaps(wide), core.merge_slots(wide)))
    assert one == other_way and core.merge_overlaps(wide.limit(0)).count() == 0


def test_dedup_of_large_ids_and_ties(spark):
    big = 10**17
    df = obs(spark, (0, 5, big + 1, "main", 9), (0, 7, big, "cont", 200), (1, 3, None, "rec", None), (1, 4, 1, "main", 9), (2, 8, 1, "main", 1), (2, 6, 1, "main", 1))
    assert {(r.interval_index, r.volume_15m) for r in core.dedup_observations(df).collect()} == {(0, 7), (1, 4), (2, 6)}
    assert {(r.interval_index, r.volume_15m) for r in core.dedup_observations(df, "priority").collect()} == {(0, 5), (1, 4), (2, 6)}


def test_gaps_are_found(spark):
    from slotwise.operators import audits

    days = [dt.date(2024, 1, d) for d in (1, 2, 4, 7)]
    df = spark.createDataFrame([(1, d, 1, 0, 5, 1, "main", 2) for d in days], SCHEMA)
    assert [r[0].day for r in audits.missing_dates(df).orderBy("count_date").collect()] == [3, 5, 6]
    months = spark.createDataFrame([("2024-01", 5), ("2024-02", 0), ("2024-03", 0)], "month_label string, month_total_volume long")
    assert [r.month_total_volume for r in trends.mask_gaps(months, ["2024-02"]).orderBy("month_label").collect()] == [5, None, 0]
    calendar = core.month_calendar(df, extra=2)
    assert [r.month_label for r in trends.month_gaps(months.filter("month_label <> '2024-02'"), calendar).collect()] == ["2024-02"]
    audit = audits.month_audit(df, calendar, ["2024-02"], "2024-03")
    assert {r.month_label: r.status for r in audit.collect()} == {"2024-01": "Detected", "2024-02": "Known unavailable", "2024-03": "Missing"}


def test_slots_of_text(spark):
    df = spark.createDataFrame([("95",), ("96",), ("200",), ("-1",), ("23:45:00",)], "t string")
    assert [r[0] for r in df.select(C.time_bin_to_minutes(F.col("t"))).collect()] == [1425, None, None, None, 1425]


def slots(**v):
    return [v.get(f"s{i}") for i in range(96)]


WIDE = "site_id int, count_date date, detector_id int, source string, source_priority int, source_file_id long, slots array<int>"


def test_modes_by_store(spark):
    modes = {"main": "filter", "cont": "nullify"}
    rows = obs(spark, (0, -5, 1, "main", 1), (0, 7, 2, "cont", 2), (1, -5, 1, "cont", 1), (1, 8, 2, "main", 2), (2, None, 1, "other", 1), (3, None, 1, "main", 1))
    won = core.dedup_observations(core.clean(rows, modes), "priority")
    assert {(r.interval_index, r.volume_15m) for r in won.collect()} == {(0, 7), (1, None), (2, None)}
    wide = spark.createDataFrame([(1, D, 1, "main", 1, 5, slots(s0=-5, s1=3)), (1, D, 1, "cont", 2, 6, slots(s0=9, s1=4, s2=-1)), (1, D, 2, "cont", 2, 6, slots(s0=-9)), (1, D, 2, "main", 3, 6, slots(s0=4, s5=5))], WIDE)
    merged = {r.detector_id: r.slots for r in core.merge_overlaps(wide, modes).collect()}
    assert merged[1][:3] == [9, 3, None] and merged[2] == [None] * 96
    assert {r.detector_id: r.slots[:6] for r in core.merge_slots(wide).collect()} == {1: [9, 3, None, None, None, None], 2: [4, None, None, None, None, 5]}
    with pytest.raises(ValueError):
        core.clean(rows, {"main": "drop"})


def test_dedup_sorts_nothing(spark):
    for order in ("file", "priority"):
        plan = core.dedup_observations(obs(spark, (0, 5, 1, "main", 2)), order)._jdf.queryExecution().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan and plan.count("Exchange hashpartitioning") <= plan.count("REPARTITION_BY_COL")


def test_stores_are_read_by_month(spark, tmp_path):
    path = str(tmp_path / "stores")
    days = [dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 2), dt.date(2024, 4, 1)]
    wide = spark.createDataFrame([(1, d, 1, s, p, i, slots(s0=i, s95=1)) for i, d in enumerate(days) for s, p in (("main", 2), ("rec", 1)) if s == "main" or d.month == 2], WIDE)
    stores.write_stores(wide, path)
    read = stores.read_stores(spark, path, {"main": 2, "rec": 1})
    assert sorted(map(str, read.select(wide.columns).collect())) == sorted(map(str, wide.collect()))
    some = core.between_dates(read, "2024-02-01", "2024-02-02")
    assert some.count() == 2
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_label" in scan
    chosen = stores.on_dates(read, ["2024-02-02", "2024-04-01"])
    assert "PartitionFilters: [month_label" in chosen._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.source, r.month_label) for r in chosen.collect()) == [("main", "2024-02"), ("main", "2024-04"), ("rec", "2024-02")]


def test_months_follow_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame([(dt.date(2024, m, d), f, v) for m, d, f, v in r], "count_date date, file string, v int")
    build = lambda df: df.groupBy("count_date").agg(F.sum("v").alias("v"))
    first = [(1, 1, "a", 1), (1, 2, "b", 2), (2, 1, "b", 4)]
    got = lambda: {(r.month_label, r.count_date.day, r.v) for r in months.read(spark, path).collect()}
    assert months.refresh(rows(*first), path, "file", build) == ["2024-01", "2024-02"]
    assert months.refresh(rows(*first), path, "file", build) == []
    late = [*first, (2, 9, "c", 8), (3, 1, None, 16), (3, 2, "c", 1)]
    with pytest.raises(RuntimeError):  # a run that dies before the manifest leaves the months as they were
        months.refresh(rows(*late), path, "file", lambda df: (_ for _ in ()).throw(RuntimeError()))
    before = {("2024-01", 1, 1), ("2024-01", 2, 2), ("2024-02", 1, 4)}
    build(rows(*late)).withColumn("month_label", C.month_label("count_date")).write.partitionBy("month_label").parquet(f"{path}/data/run=dead")
    assert got() == before
    assert months.changed_months(rows(*late), path, "file") == ["2024-02", "2024-03"]
    assert months.refresh(rows(*late), path, "file", build) == ["2024-02", "2024-03"]
    assert got() == before | {("2024-02", 9, 8), ("2024-03", 1, 16), ("2024-03", 2, 1)}
    gone = [r for r in late if r[2] != "c"]
    assert months.refresh(rows(*gone), path, "file", build) == ["2024-02", "2024-03"]
    assert months.refresh(rows(*gone), path, "file", build) == []
    assert got() == before | {("2024-03", 1, 16)}


def test_files_are_listed_and_compared_by_all_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda n: spark.range(n).selectExpr("date_add(date'2024-01-01', cast(id % 60 as int)) AS count_date", "id AS file", "1 AS v")
    listed = lambda: {(r.month_label, r.file) for r in months.manifest(spark, path).collect()}
    expected = lambda n: {(f"2024-0{1 if i % 60 < 31 else 2}", str(i)) for i in range(n)}
    assert months.refresh(rows(600), path, "file") == ["2024-01", "2024-02"]
    assert spark.read.parquet(f"{path}/manifest").count() == 2  # one row a month, as one task writes them
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # nothing is sorted by month
        assert "SortMergeJoin" not in months.manifest(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert listed() == expected(600)
    # files that a dead run has listed count for nothing
    rows(900).selectExpr("'2024-01' AS month_label", "cast(file AS string) AS file").write.parquet(f"{path}/files/run=dead")
    assert listed() == expected(600)
    for tasks in (None, 3):
        assert months.changed_months(rows(600), path, "file", tasks=tasks) == []
        assert months.changed_months(rows(601), path, "file", tasks=tasks) == ["2024-01"]
        assert months.changed_months(rows(599), path, "file", tasks=tasks) == ["2024-02"]
    assert months.refresh(rows(601), path, "file", tasks=3) == ["2024-01"]
    assert sorted(len(list(run.glob("part-*"))) for run in tmp_path.glob("t/files/run=*") if run.name != "run=dead")[-1] == 3
    assert listed() == expected(601)
    assert months.read(spark, path).count() == 601


def test_manifests_that_name_files_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame([(dt.date(2024, m, 1), f, v) for m, f, v in r], "count_date date, file string, v int")
    old = [(1, "a", 1), (2, "a", 2), (2, "b", 4)]
    rows(*old).withColumn("month_label", C.month_label("count_date")).write.partitionBy("month_label").parquet(f"{path}/data/run=old")
    spark.createDataFrame([("2024-01", "a", "old", 1), ("2024-02", "a", "old", 1), ("2024-02", "b", "old", 1), ("2024-03", None, "old", 1)], "month_label string, file string, run string, epoch long").write.parquet(f"{path}/manifest")
    assert months.refresh(rows(*old), path, "file") == []
    assert months.refresh(rows(*old[:2]), path, "file") == ["2024-02"]
    assert sorted((r.month_label, r.v) for r in months.read(spark, path).collect()) == [("2024-01", 1), ("2024-02", 2)]
    assert months.refresh(rows(*old[:2]), path, "file") == []


def test_cubes_hold_all_totals(spark, tmp_path):
    df = obs(spark, (0, 5, 1, "main", 2), (1, None, 1, "main", 2), (95, 7, 1, "main", 2)).withColumn("site_id", F.when(F.col("interval_index") != 95, 1))
    cubes.write(df, str(tmp_path / "c"))
    cells = spark.read.schema(cubes.SCHEMA).parquet(str(tmp_path / "c"))
    assert {(r.site_id, r.volume_15m, r.n_rows) for r in cubes.site_days(cells).collect()} == {(1, 5, 2), (None, 7, 1)}
    assert {(r.time_bin, r.volume_15m, r.n_rows) for r in cubes.day_bins(cells).collect()} == {("00:00", 5, 1), ("00:15", None, 1), ("23:45", 7, 1)}
    assert profiles.dataset_summary(cubes.site_days(cells)).first().row_count == 3
    assert "cube" not in cubes.day_bins(cells).columns


def test_nearest_on_the_whole_globe(spark):
    import math
    import random

    rng = random.Random(4)
    hubs = [(90.0, 0.0), (-90.0, 20.0), (0.0, 180.0), (10.0, -180.0), (75.0, 10.0), (-37.8, 145.0), (0.0, 0.0)]
    place = lambda: (lambda h: (max(-90.0, min(90.0, h[0] + rng.gauss(0, 0.001))), (h[1] + rng.gauss(0, 0.002) + 180) % 360 - 180))(rng.choice(hubs))
    points, features = [(i, *place()) for i in range(60)], [(i, *place()) for i in range(120)]
    points += [(900, None, 1.0), (901, 10.0, 179.9999), (902, 75.0, 10.0008)]
    features += [(900, 10.0, -179.9999), (902, 75.0, 10.0025)]

    def metres(a, b):
        (la, lo), (lb, ob) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
        h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - ob) / 2) ** 2
        return 2 * sites.EARTH * math.asin(math.sqrt(min(1.0, h)))

    for reach in (50.0, 3000.0):
        want = {}
        for p, lat, lon in points:
            near = sorted((metres((lat, lon), (fl, fo)), f) for f, fl, fo in features) if lat is not None else []
            if near and near[0][0] <= reach:
                want[p] = near[0][1]
        got = sites.nearest_within(spark.createDataFrame(points, "site_id int, latitude double, longitude double"), spark.createDataFrame(features, "feature_id int, latitude double, longitude double"), reach)
        assert {r.site_id: r.feature_id for r in got.collect()} == want
        assert {901, 902} <= set(want)


def test_names_and_labels(spark):
    names = ["SMITH ST/JONES AVE", "Smith St/Jones", "A BTW B", "O'BRIEN ST", "  ", None, "nan", "PHE NR CBD", "Bell St NR High St", "MRR HWY"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(C.friendly_name(F.col("n"), F.col("i"))).collect()]
    assert got == ["Smith Street / Jones Avenue", "Smith St / Jones", "A between B", "O'Brien Street", "SCATS Site 4", "SCATS Site 5", "SCATS Site 6", "Princes Highway East near CBD", "Bell St near High St", "MRR Highway"]
    labels = ["2024-01", "2024-01-31", "44", "44.0", "N/A", "none", "", None, "a_b  c", "y" * 58, "y" * 59, "4.4"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, n string")
    assert [r[0] for r in df.orderBy("i").select(C.clean_label(F.col("n"))).collect()] == ["", "", "", "", "", "", "", "", "a b c", "y" * 58, "y" * 57 + "…", "4.4"]


def test_lookup_keeps_one_row(spark):
    schema = "site_id int, site_name string, latitude double, longitude double, lookup_order int"
    rows = [(1, "long name", -37.0, None, 1), (1, "name", -38.0, 145.0, 2), (2, "a", -38.0, 145.0, 2), (2, "b", -38.5, 145.5, 1), (3, "far", 10.0, 145.0, 1), (4, None, -38.0, 145.0, 1)]
    over = spark.createDataFrame([(2, None, -39.0, 146.0), (4, "named", None, None)], "site_id int, site_name string, latitude double, longitude double")
    best = sites.best_site_lookup(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, best.collect())) == [(1, "name", -38.0, 145.0), (2, "b", -38.5, 145.5), (4, "", -38.0, 145.0)]
    moved = sites.best_site_lookup(spark.createDataFrame(rows, schema), over)
    assert sorted(map(tuple, moved.collect())) == [(1, "name", -38.0, 145.0), (2, "b", -39.0, 146.0), (4, "named", -38.0, 145.0)]


def test_years_months_and_audits(spark):
    from slotwise.operators import audits

    table = lambda rows: spark.createDataFrame([(m, v, None if v == 0 else 30, None if v == 0 else v / 30, "zero_row_month" if v == 0 else "data") for m, v in rows], "month_label string, month_total_volume long, days_loaded long, avg_daily_volume double, row_type string")
    rows = [(f"{y}-{m:02d}", 100 * (y - 2016) * (0 if (y, m) == (2018, 12) else 1)) for y in (2017, 2018, 2019) for m in range(1, 13)] + [("2020-01", 100)]
    got = {r.year: r for r in trends.year_trend(table(rows)).collect()}
    assert [(y, got[y].valid_months, got[y].is_partial, got[y]["index"], got[y].yoy_pct) for y in sorted(got)] == [(2017, 12, False, 100.0, None), (2018, 11, True, pytest.approx(2200 / 12), pytest.approx(1000 / 12)), (2019, 12, False, 300.0, pytest.approx(1400 / 22)), (2020, 1, True, None, None)]
    dates = spark.createDataFrame([(1, dt.date(2024, m, 1), 1, 0, 5, 1, "main", 2) for m in (1, 3, 4)], SCHEMA)
    audit = audits.month_audit(dates, core.month_calendar(dates, extra=1), ["2024-02", "2024-04"], "2024-04")
    assert {r.month_label: r.status for r in audit.collect()} == {"2024-01": "Detected", "2024-02": "Known unavailable", "2024-03": "Detected", "2024-04": "Detected partial final month", "2024-05": "Missing"}
    year = audits.year_audit(audit, 2024).first()
    assert (year.expected_months, year.detected_months, year.known_unavailable_months, year.valid_months_detected, year.missing_unexplained_months, year.is_partial_year) == (5, 3, 2, 1, 0, True)


def test_pulse_without_volume(spark):
    rows = spark.createDataFrame([(1, D, "07:00", 0), (2, D, "07:00", 5)], "site_id int, count_date date, time_bin string, volume long")
    place = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "b", None, 2.0)], "site_id int, site_name string, latitude double, longitude double")
    assert exports.enrich_pulse(rows, place).collect() == []
    r = exports.enrich_pulse(rows, place, 0).first()
    assert (r.scaled_volume, r.scaled_volume_0_100, r.intensity_band, r.time_label, r.day_name) == (0.0, 0.0, "extreme", "07:00", "Monday")


def test_ranks_and_shares_over_ranges(spark):
    """Cut in many ranges, with ties, a hot value and nulls: as one window over all rows has it, and no exchange to one partition of the rows."""
    import random

    from pyspark.sql import Window

    from slotwise.operators import ordered

    rng = random.Random(2)
    rows = [(i, rng.choice([None, 5, 5, 5, rng.randrange(50), rng.randrange(10**6)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "site_id int, v long").repartition(7)
    at = ordered.cuts(df, "v", 200)
    assert len(at) > 3
    order = Window.orderBy(F.desc_nulls_last("v"), "site_id")
    want = df.select("site_id", F.row_number().over(order).alias("rank"), F.coalesce(F.sum("v").over(order), F.lit(0)).alias("cumulative_volume"))
    got = ordered.ranked(df, "v", "site_id", at)
    assert sorted(map(tuple, got.select("site_id", "rank", "cumulative_volume").collect())) == sorted(map(tuple, want.collect()))
    assert got.select("all_rows", "all_volume").distinct().collect() == [(3000, sum(v for _, v in rows if v is not None))]
    assert [r[0] for r in ordered.ranked(df, "v", "site_id", []).orderBy("site_id").select("rank").collect()] == [r[0] for r in got.orderBy("site_id").select("rank").collect()]
    shares = {r.site_id: r.p for r in df.select("site_id", C.pct_rank(F.col("v")).alias("p")).collect()}
    assert {r.site_id: r.pct_rank for r in ordered.pct_rank(df, "v", at=at).collect()} == pytest.approx(shares)
    # what is sorted in one task are range totals
    for part in got._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1:]:
        assert "windowspecdefinition(_range" in part or "_rows" in part or "_volume" in part
    assert ordered.ranked(df.filter("false"), "v", "site_id").collect() == []


def test_quantiles_equal_percentile(spark):
    from slotwise.operators import ordered

    shares = [0.0, 0.1, 0.37, 0.5, 0.98, 1.0]
    for sql in ("cast(id % 7 as double)", "exp(id / 40.0)", "-1.0 * id * id", "cast(if(id < 900, 3, id) as double)", "if(id % 3 = 0, null, rand(4))", "1e-300 * id"):
        df = spark.range(1000).selectExpr(f"{sql} AS v")
        want = df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
        assert ordered.quantiles(df, "v", shares, bins=16) == pytest.approx(want, rel=1e-12)
    assert ordered.quantiles(spark.range(0).selectExpr("id AS v"), "v", [0.5]) == [None]


def test_crossings_join_nothing(spark):
    bins = spark.createDataFrame([("00:00", 10), ("00:15", 0), ("00:30", 70), ("00:45", 20)], "time_bin string, total_volume long")
    got = trends.time_at_share(bins, [5, 10, 11, 80, 100])
    assert sorted(map(tuple, got.collect())) == [(5.0, "00:00"), (10.0, "00:00"), (11.0, "00:30"), (80.0, "00:30"), (100.0, "00:45")]
    totals = spark.createDataFrame([(i, v) for i, v in enumerate((50, 30, 15, 5))], "site_id int, total_volume long")
    got2 = sites.concentration_milestones(totals, [1, 50, 80.5, 100])
    assert sorted(map(tuple, got2.collect())) == [(1.0, 1), (50.0, 1), (80.5, 3), (100.0, 4)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() + got2._jdf.queryExecution().executedPlan().toString()


def test_coverage_states_add_up(spark):
    import random

    from slotwise.operators import audits

    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 40_000, 70_000, None]), dt.date(rng.choice([1960, 1999, 2024]), rng.randrange(1, 13), rng.randrange(1, 28)), rng.choice([0, 3, 1023, None]), 0, rng.choice([None, 4]), 1, rng.choice(["a", "b"]), 1) for _ in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("year", F.year("count_date").cast("string"))
    got = audits.merge_coverage(audits.coverage_state(df, "source", "year"), {"source": F.col("source"), "year": F.col("year"), "all": F.lit("x")})
    want = set()
    for level, key in (("source", lambda r: r[6]), ("year", lambda r: str(r[1].year)), ("all", lambda r: "x")):
        for k in {key(r) for r in rows}:
            own = [r for r in rows if key(r) == k]
            pairs = {(r[0], r[2]) for r in own if r[0] is not None and r[2] is not None}
            want.add((level, k, len(own), len({r[1] for r in own}), len({r[0] for r in own} - {None}), len(pairs), sum(r[4] or 0 for r in own)))
    assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(Exception, match="detector number out of range"):
        audits.coverage_state(df.withColumn("detector_id", F.lit(1024)), "source").collect()


def test_dedup_deals_tasks_by_rows(spark, monkeypatch):
    """A task's maps hold so many observations, however many there are."""
    monkeypatch.setattr(core, "PER_TASK", 20)
    df = obs(spark, *[(i % 96, i, i, "main", 2) for i in range(150)])
    won = core.dedup_observations(df)
    assert won.rdd.getNumPartitions() == 8
    assert sorted(r.source_file_id for r in won.collect()) == list(range(96))
    assert core.tasks_for(df.limit(0)) == 1


def test_cube_months_are_parted_among_tasks(spark, tmp_path):
    """With more tasks than months no task sorts a whole month."""
    df = spark.range(400).select(F.col("id").cast("int").alias("site_id"), F.lit(D).alias("count_date"), F.lit(0).alias("interval_index"), F.lit(1).alias("volume_15m"))
    path = str(tmp_path / "cubes")
    cubes.write(df, path, tasks=4, months=1)
    cells = spark.read.schema(cubes.SCHEMA).parquet(path)
    assert cubes.site_days(cells).select(F.input_file_name()).distinct().count() > 1
    assert (cubes.site_days(cells).count(), cubes.day_bins(cells).first().volume_15m) == (400, 400)


def test_proximity_pairs_are_not_sorted_or_shuffled(spark):
    """Many rows of few places: pairs stand for places, and only sums by place leave the join."""
    points = spark.range(600).select(F.col("id").cast("int").alias("site_id"), (F.col("id") % 3 / 1000.0).alias("latitude"), F.lit(10.0).alias("longitude"))
    features = spark.range(600).select((600 - F.col("id")).cast("int").alias("feature_id"), (F.col("id") % 3 / 1000.0).alias("latitude"), F.lit(10.0005).alias("longitude"))
    got = sites.nearest_within(points, features, 500.0)
    assert {(r.site_id % 3, r.feature_id) for r in got.collect()} == {(0, 3), (1, 2), (2, 1)} and got.count() == 600
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") >= 4


def test_stores_are_dealt_before_they_are_spread(spark, tmp_path):
    """Counts become 96 columns after the shuffle and the sort by month; several tasks part a month."""
    schema = "site_id int, count_date date, detector_id int, source_file_id long, source string, counts array<struct<interval_index:int,volume_15m:int>>"
    days = spark.createDataFrame([(i, D, 1, i, "main", [(5, 2), (i % 96, 3), (5, 1)]) for i in range(200)], schema)
    path = str(tmp_path / "stores")
    stores.write_stores(days, path, tasks=4, months=1)
    read = stores.read_stores(spark, path, {"main": 2})
    assert read.select(F.input_file_name()).distinct().count() > 1
    got = {r.site_id: r for r in read.select("site_id", core.slots_count(F.col("slots")).alias("n"), core.slots_total(F.col("slots")).alias("v"), F.get("slots", F.lit(5)).alias("s5")).collect()}
    assert len(got) == 200 and {r.v for r in got.values()} == {6}
    assert (got[5].n, got[5].s5) == (1, 6) and (got[6].n, got[6].s5) == (2, 3)


def test_merge_deals_detector_days_before_listing_them(spark, monkeypatch):
    """No list of wide rows on the side of the files, and tasks by the number of detector-days."""
    monkeypatch.setattr(core, "PER_TASK", 20)
    days = spark.range(150).select(F.col("id").cast("int").alias("site_id"), F.date_add(F.lit(D), (F.col("id") % 3).cast("int")).alias("count_date"), (F.col("id") % 2).cast("int").alias("detector_id"), F.lit(1).alias("source_priority"), "id", F.array_repeat(F.lit(2), 96).alias("slots")).withColumnRenamed("id", "source_file_id")
    merged = core.merge_slots(days)
    assert {r.v for r in merged.select(core.slots_total(F.col("slots")).alias("v")).collect()} == {192} and merged.count() == 150
    plan = merged._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and ", 8), REPARTITION_BY_NUM" in plan[dealt[0]]
    assert max(i for i, line in enumerate(plan) if "ObjectHashAggregate" in line) < dealt[0]


def test_stored_days_keep_filled_slots_alone(spark, tmp_path):
    """A store has as many values as counts, not 96 a row, and is built in one shuffle; merged by counts it equals the merge of 96 slots."""
    rows = obs(spark, (5, 2, 9, "main", 2), (5, 1, 8, "main", 2), (3, -4, 7, "main", 2), (7, None, 7, "main", 2), (3, 6, 1, "rec", 1), (9, -1, 2, "rec", 1))
    rows = rows.unionByName(rows.withColumns({"count_date": F.lit("2024-03-05").cast("date"), "detector_id": F.lit(4)}).filter("source = 'main'"))
    keys = ["site_id", "count_date", "detector_id", "source"]
    days = stores.list_counts(stores.deal(rows, 4, 3), keys)
    assert days._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    path = str(tmp_path / "stores")
    stores.write_stores(days, path)
    assert spark.read.parquet(path).columns[-3:] == ["counts", "source", "month_label"]
    read = stores.read_stores(spark, path, {"main": 2, "rec": 1})
    got = {(r.count_date.month, r.source): (list(map(tuple, r.counts)), r.source_file_id) for r in read.collect()}
    assert got == {(1, "main"): ([(3, -4), (5, 3), (7, None)], 7), (3, "main"): ([(3, -4), (5, 3), (7, None)], 7), (1, "rec"): ([(3, 6), (9, -1)], 1)}
    sums = read.select(core.counts_count(F.col("counts")) == core.slots_count(F.col("slots")), core.counts_total(F.col("counts")) == core.slots_total(F.col("slots")))
    assert {tuple(r) for r in sums.collect()} == {(True, True)}


@pytest.mark.parametrize("mode", ["filter", "nullify", {"main": "filter", "cont": "nullify"}])
def test_merge_by_counts_equals_merge_by_slots(spark, mode):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        files = rng.sample([None, 5, 6, 7], 4)
        for (source, priority), file in zip(rng.sample([("main", 2), ("cont", 2), ("rec", None), ("old", 1)], rng.randint(1, 4)), files):
            filled = rng.sample(range(96), rng.choice([0, 1, 3, 60, 96]))
            rows.append((i, D + dt.timedelta(i % 3), 1, source, priority, file, [rng.randint(-3, 9) if k in filled else None for k in range(96)]))
    wide = spark.createDataFrame(rows, WIDE)
    kept = wide.withColumn("counts", core.slots_to_counts(F.col("slots"))).drop("slots")
    keys = ["site_id", "count_date", "detector_id"]
    for merge in (core.merge_slots, core.merge_overlaps):
        by_slots = {tuple(r[:3]): r.slots for r in merge(wide, mode).select(*keys, "slots").collect()}
        other = core.merge_counts(kept, mode).withColumn("slots", core.counts_to_slots(F.col("counts"))) if merge is core.merge_slots else merge(kept, mode)
        assert {tuple(r[:3]): r.slots for r in other.select(*keys, "slots").collect()} == by_slots
