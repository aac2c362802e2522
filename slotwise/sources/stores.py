"""Reading stores and summaries, writing results, and refreshing months."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions import columns as C
from slotwise.operators.core import add_counts, counts_to_slots, require_columns, slots_to_counts

SLOTS = [f"v{i:02d}" for i in range(96)]
_KEYS = [("scats_site", T.IntegerType()), ("count_date", T.DateType()), ("detector", T.IntegerType()), ("region_code", T.StringType()), ("ct_records", T.ShortType()), ("volume_24hour", T.IntegerType()), ("alarm_24hour", T.IntegerType()), ("source_file_id", T.LongType())]
#: One row a site, date and detector, with 96 columns of counts.
DETECTOR_DAY = T.StructType([T.StructField(n, t) for n, t in _KEYS] + [T.StructField(c, T.IntegerType()) for c in SLOTS])
#: What a stored detector-day keeps of its filled slots.
_COUNTS = T.ArrayType(T.StructType([T.StructField("interval_index", T.IntegerType()), T.StructField("volume_15m", T.IntegerType())]))
_ROW = ["scats_site AS site_id", "count_date", "detector AS detector_id", "region_code", "ct_records", "volume_24hour", "alarm_24hour", "source_file_id", f"array({', '.join(SLOTS)}) AS slots"]


def read_detector_days(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Wide facts with an explicit schema; the 96 columns become one array, so later steps carry one column."""
    reader = spark.read.schema(DETECTOR_DAY)
    df = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    return df.selectExpr(*_ROW)


def read_sources(spark: SparkSession, stores: dict[str, tuple[str, int]], kind: str = "parquet") -> DataFrame:
    """Several stores, name to (path, priority), as one input."""
    tagged = [read_detector_days(spark, path, kind).withColumns({"source": F.lit(name), "source_priority": F.lit(priority)}) for name, (path, priority) in stores.items()]
    return reduce(DataFrame.unionByName, tagged)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, where tables that several steps read are written; only a session in one process, as in tests, may do without and use the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _known(wide: DataFrame) -> list[Column]:
    known = {"scats_site": "site_id", "count_date": "count_date", "detector": "detector_id", "source_file_id": "source_file_id"}
    return [(F.col(known[n]) if n in known else F.lit(None)).cast(t).alias(n) for n, t in _KEYS]


def write_detector_days(wide: DataFrame, path: str) -> None:
    """Detector-days with an array of slots, as the 96 columns that ``read_detector_days`` takes; what is not known is null."""
    wide.select(*_known(wide), *[F.get("slots", F.lit(i)).cast("int").alias(c) for i, c in enumerate(SLOTS)]).write.parquet(path)


def deal(rows: DataFrame, tasks: int, months: int) -> DataFrame:
    """``rows`` dealt by ``bin``, the month and the share of its detector-days: a month is parted among its share of the tasks."""
    shares = -(-tasks // months)
    month = F.year("count_date") * 12 + F.month("count_date")
    return rows.withColumn("bin", month * shares + F.pmod(F.hash("site_id", "count_date", "detector_id"), F.lit(shares))).repartition(tasks, "bin")


def list_counts(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """Detector-days (``keys``) out of observations that ``deal`` has dealt, with their ``counts`` as they come: no shuffle, one sort by numbers, and rows lie by month."""
    day = Window.partitionBy("bin", *keys).orderBy("interval_index")
    all_of = day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = F.collect_list(F.struct("interval_index", "volume_15m")).over(all_of).alias("counts")
    listed = dealt.select("bin", *keys, counts, F.min("source_file_id").over(all_of).alias("source_file_id"), F.row_number().over(day).alias("_r"))
    return listed.filter("_r = 1").drop("_r")


def write_stores(wide: DataFrame, path: str, tasks: int = 1, months: int = 1) -> None:
    """Detector-days of several stores as one table, a folder a month, with the ``counts`` (slot, volume) of their filled slots, by slot.

    An empty slot costs nothing, neither here nor where it is read: as 96 columns, nearly all cells of sparse stores are nulls that are written and read one by one.
    Rows have ``slots`` or ``counts``; several counts of a slot are added. With several ``tasks`` a month is parted among its share of them; else large partitions are split and
    small ones written together. Rows with a ``bin`` have been dealt (``deal``) and are written where they lie.
    """
    counts = add_counts(F.col("counts")) if "counts" in wide.columns else slots_to_counts(F.col("slots"))
    labelled = wide.withColumn("month_label", C.month_label(F.col("count_date")))
    dealt = labelled if "bin" in wide.columns else deal(labelled, tasks, months) if tasks > 1 else labelled.hint("rebalance", "month_label")
    dealt.select(*_known(dealt), F.coalesce(counts, F.array().cast(_COUNTS)).alias("counts"), "source", "month_label").write.partitionBy("month_label").parquet(path)


def read_stores(spark: SparkSession, path: str, priorities: dict[str, int]) -> DataFrame:
    """A table of ``write_stores`` as one scan, with each source's priority, its ``counts``, and the 96 ``slots`` where they are asked for.

    ``month_label`` stays: a filter on it (``core.between_dates`` adds one) keeps other months' files unread.
    """
    schema = T.StructType([*[T.StructField(n, t) for n, t in _KEYS], T.StructField("counts", _COUNTS), T.StructField("source", T.StringType()), T.StructField("month_label", T.StringType())])
    priority = C.first_match(*[(F.col("source") == n, F.lit(p)) for n, p in priorities.items()])
    slots = counts_to_slots(F.col("counts")).alias("slots")
    return spark.read.schema(schema).parquet(path).select(*map(F.expr, _ROW[:-1]), "counts", slots, "source", priority.alias("source_priority"), "month_label")


def on_dates(stored: DataFrame, dates: list[str]) -> DataFrame:
    """Rows of chosen dates ('yyyy-MM-dd', few enough to be named); only their months' folders are listed and read."""
    return stored.filter(F.col("month_label").isin(sorted({d[:7] for d in dates})) & F.col("count_date").isin(*[F.lit(d).cast("date") for d in dates]))


def data_rows(df: DataFrame, kinds: tuple[str, ...] = ("data", "normal")) -> DataFrame:
    return df.filter(F.lower("row_type").isin(*kinds))


def read_summary_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All columns as text, then converted; text that does not fit is null, and rows whose first column does not fit (markers) go."""
    text = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).option("header", True).csv(path)
    first = schema.fields[0].name
    return text.select(*[F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema]).filter(F.col(first).isNotNull())


def latest_by_key(df: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """The row of the latest run for each key; of rows that tie, one."""
    newest = Window.partitionBy(*keys).orderBy(F.col(epoch).desc_nulls_last(), F.hash(*df.columns))
    return df.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def latest_run(df: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """All rows of the latest run of each key."""
    newest = F.max(epoch).over(Window.partitionBy(*keys))
    return df.withColumn("_e", newest).filter(F.col(epoch).eqNullSafe(F.col("_e"))).drop("_e")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records, flat or with structs."""
    df.write.mode("overwrite").json(path)


def write_result(df: DataFrame, path: str) -> None:
    """CSV, JSON or Parquet by the path's suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    writers = {"csv": write_csv, "json": write_json, "parquet": lambda d, p: d.write.mode("overwrite").parquet(p)}
    if kind not in writers:
        raise ValueError(f"unknown suffix {kind!r}")
    writers[kind](df, path)


def _months_of(spark: SparkSession, path: str) -> list[str]:
    """The months that a table has (one value a month); none if there is no table."""
    try:
        return sorted(r[0] for r in spark.read.option("partitionColumnTypeInference.enabled", False).parquet(path).select("month_label").distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def refresh_months(df: DataFrame, path: str, months: list[str] | None = None, date: str = "count_date") -> DataFrame:
    """Rewrites the given months of a table partitioned by month (all that are missing, if none are given) and leaves the others.

    Months run in one job, each dealt by date; a late file is handled by naming its months again. The result is the table.
    """
    spark = df.sparkSession
    require_columns(df, [date])
    labelled = df.withColumn("month_label", C.month_label(F.col(date)))
    if months is None:
        done = _months_of(spark, path)
        wanted = labelled.filter(~F.col("month_label").isin(done)) if done else labelled
    else:
        wanted = labelled.filter(F.col("month_label").isin(months))
    wanted.repartition("month_label", date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_label").parquet(path)
    return spark.read.option("partitionColumnTypeInference.enabled", False).parquet(path)
