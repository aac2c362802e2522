"""Readers that bring other feeds to the observation model.

Observation: site_id, count_date, detector_id, interval_index (0..95), volume_15m, source_file_id, source, source_priority.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core
from slotwise.sources import cubes, stores

#: The stores and their priorities.
PRIORITIES = {"main": 2, "cont": 3, "rec": 1}
#: The mode in which each store is cleaned where stores are merged.
MODES = {"main": "filter", "cont": "nullify", "rec": "nullify"}
_WRITTEN: dict[tuple[str, ...], str] = {}
_LOCK = RLock()
DETECTORS = {"view": 1, "click": 2, "purchase": 3, "signup": 4, "error": 5}


def to_observations(feed: DataFrame, ts: str, site: str, detector: str, volume: str) -> DataFrame:
    """A feed of timestamped counts as observations: counts of one site, date, detector and slot are added."""
    keyed = feed.select(F.col(site).cast("int").alias("site_id"), F.to_date(ts).alias("count_date"), F.col(detector).cast("int").alias("detector_id"), C.timestamp_to_slot(F.col(ts)).alias("interval_index"), F.col(volume).alias("v"))
    return keyed.groupBy("site_id", "count_date", "detector_id", "interval_index").agg(F.sum("v").alias("volume_15m"))


def _with_overlap(obs: DataFrame) -> DataFrame:
    """Adds the recovery store: copies of some rows, one count higher, under other file ids. One scan: a row and its copy are exploded."""
    own = F.struct("volume_15m", "source_file_id", "source", "source_priority")
    copy = F.struct((F.col("volume_15m") + 1).alias("volume_15m"), (F.col("source_file_id") + 1000000000).alias("source_file_id"), F.lit("rec").alias("source"), F.lit(1).alias("source_priority"))
    both = F.when(F.col("source_file_id") % 20 == 0, F.array(own, copy)).otherwise(F.array(own))
    return obs.select("site_id", "count_date", "detector_id", "interval_index", F.explode(both).alias("o")).select("site_id", "count_date", "detector_id", "interval_index", "o.*")


class Tables:
    """The model's tables over one folder of Parquet tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._states: dict[str, str] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """Observations over years, from order lines, in three overlapping stores."""
        date = F.to_date("l_shipdate")
        main = date < F.lit("1998-07-01").cast("date")
        return _with_overlap(
            self.read("lineitem").select(
                F.col("l_suppkey").cast("int").alias("site_id"), date.alias("count_date"), F.col("l_linenumber").cast("int").alias("detector_id"), (F.col("l_partkey") % 96).cast("int").alias("interval_index"),
                (F.col("l_quantity").cast("int") - 2).alias("volume_15m"), F.col("l_orderkey").alias("source_file_id"), F.when(main, "main").otherwise("cont").alias("source"), F.when(main, 2).otherwise(3).alias("source_priority"),
            )
        )

    @cached_property
    def raw_days(self) -> DataFrame:
        """Observations within a month, from events, with null volumes."""
        date = F.to_date("ts")
        main = date < F.lit("2024-01-16").cast("date")
        kind = C.first_match(*[(F.col("event_type") == k, v) for k, v in DETECTORS.items()])
        return _with_overlap(
            self.read("events").select(
                F.col("user_id").cast("int").alias("site_id"), date.alias("count_date"), kind.alias("detector_id"), C.timestamp_to_slot(F.col("ts")).alias("interval_index"),
                F.when(F.col("event_id") % 97 != 0, F.floor("value").cast("int") - 10).alias("volume_15m"), F.col("event_id").alias("source_file_id"), F.when(main, "main").otherwise("cont").alias("source"), F.when(main, 2).otherwise(3).alias("source_priority"),
            )
        )

    @cached_property
    def obs_tasks(self) -> int:
        return core.tasks_for(self.read("lineitem"))

    @cached_property
    def store_tasks(self) -> int:
        """Detector-days cost more than observations: 96 slots each."""
        return core.tasks_for(self.read("lineitem"), 60_000)

    @cached_property
    def months(self) -> int:
        """Months of the calendar from the first date to the last."""
        first, last = self.read("lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
        return 1 if first is None else (last.year - first.year) * 12 + last.month - first.month + 1

    @cached_property
    def obs(self) -> DataFrame:
        return core.dedup_observations(core.clean(self.raw, "filter"), order="file", tasks=self.obs_tasks).withColumn("time_bin", C.slot_to_time_bin(F.col("interval_index")))

    @cached_property
    def obs_days(self) -> DataFrame:
        return core.dedup_observations(core.clean(self.raw_days, "nullify"), order="priority", tasks=core.tasks_for(self.read("events"))).withColumn("time_bin", C.slot_to_time_bin(F.col("interval_index")))

    @cached_property
    def sites(self) -> DataFrame:
        s, n, r = self.read("supplier"), self.read("nation"), self.read("region")
        placed = F.col("s_suppkey") % 13 != 0
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select(
            F.col("s_suppkey").cast("int").alias("site_id"), F.col("s_name").alias("site_name"), F.col("n_name").alias("municipality"), F.col("r_name").alias("region_code"),
            F.when(placed, F.lit(-37.8) + (F.col("s_suppkey") % 41 - 20) / F.lit(100.0)).alias("latitude"), F.when(placed, F.lit(145.0) + (F.col("s_suppkey") % 37 - 18) / F.lit(100.0)).alias("longitude"),
        )

    @cached_property
    def features(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").select(k.alias("feature_id"), (F.lit(-37.8) + (k % 997 - 498) / F.lit(2000.0)).alias("latitude"), (F.lit(145.0) + (k % 991 - 495) / F.lit(2000.0)).alias("longitude"))

    @cached_property
    def counts(self) -> DataFrame:
        """Detector-days of each store with their counts as they come, (slot, volume) in an array."""
        keys = ["source", "source_priority", "site_id", "count_date", "detector_id"]
        return self.raw.repartition(self.store_tasks, *keys).groupBy(*keys).agg(F.collect_list(F.struct("interval_index", "volume_15m")).alias("counts"), F.min("source_file_id").alias("source_file_id"))

    @cached_property
    def dealt_counts(self) -> DataFrame:
        """``counts``, dealt and listed by month for their writing."""
        return stores.list_counts(stores.deal(self.raw, self.store_tasks, self.months), ["site_id", "count_date", "detector_id", "source"])

    @cached_property
    def wide(self) -> DataFrame:
        """Detector-days of each store: 96 slots in an array (several counts of a slot are added)."""
        return self.counts.withColumn("slots", core.put_slots(F.col("counts"))).drop("counts")

    def scratch(self, name: str) -> str:
        """A new path in the shared folder."""
        return f"{stores.shared_folder(self.spark)}/slotwise-{name}-{uuid.uuid4().hex}"

    def state(self, table: str) -> str:
        """A print of the sizes and times of a source's files, taken once a query."""
        if table not in self._states:
            files = self.spark.read.format("binaryFile").load(f"{self.folder}/{table}.parquet").select(F.xxhash64("path", "length", "modificationTime").alias("h"))
            self._states[table] = str(files.agg(F.sort_array(F.collect_list("h"))).first()[0])
        return self._states[table]

    def written(self, name: str, table: str, write: Callable[[str], None]) -> str:
        """Where ``write`` has put a table derived from ``table``: once a session and state of the source's files."""
        key = (self.spark.sparkContext.applicationId, self.folder, name, self.state(table))
        with _LOCK:
            if key not in _WRITTEN:
                path = self.scratch(name)
                write(path)
                _WRITTEN[key] = path
        return _WRITTEN[key]

    @cached_property
    def stored(self) -> DataFrame:
        """``wide`` as three stores by month, written once and read as one input."""
        path = self.written("stores", "lineitem", lambda path: stores.write_stores(self.dealt_counts, path))
        return stores.read_stores(self.spark, path, PRIORITIES)

    @cached_property
    def shared(self) -> DataFrame:
        """Dates that several stores have, written down."""
        return self.spark.read.schema("count_date date").parquet(self.written("shared-dates", "lineitem", lambda path: core.shared_dates(self.stored).write.parquet(path)))

    @cached_property
    def cells(self) -> DataFrame:
        """The base cubes of ``obs``, written once by month."""
        path = self.written("cubes", "lineitem", lambda path: cubes.write(self.obs, path, self.obs_tasks, self.months))
        return self.spark.read.schema(cubes.SCHEMA).parquet(path)

    @cached_property
    def site_days(self) -> DataFrame:
        return cubes.site_days(self.cells)

    @cached_property
    def day_bins(self) -> DataFrame:
        return cubes.day_bins(self.cells)

    @cached_property
    def merged(self) -> DataFrame:
        """Clean detector-days: one a site, date and detector."""
        return core.merge_overlaps(self.stored, shared=self.shared)

    def merged_by_month(self, first: str, end: str) -> DataFrame:
        """``merged`` of the months that dates from ``first`` to ``end`` fall in, read from their folders alone."""
        return core.merge_overlaps(core.between_dates(self.stored, first, end), shared=self.shared)

    @cached_property
    def daily(self) -> DataFrame:
        return core.daily_totals(self.site_days)

    @cached_property
    def sm(self) -> DataFrame:
        return core.site_month_totals(self.site_days)

    @cached_property
    def monthly(self) -> DataFrame:
        return self.site_days.groupBy(C.month_label(F.col("count_date")).alias("month_label")).agg(F.sum("volume_15m").alias("month_total_volume"))

    @cached_property
    def site_totals(self) -> DataFrame:
        return core.site_totals(self.site_days)
