"""Tables kept by month: a manifest says which run of each month counts, and each run lists the files its months were built from.

A refresh compares the input's (file, month) pairs with those listed, rebuilds whole months whose files differ, writes them beside the old ones as a new run, lists
their files, and only then adds the run to the manifest, in one file of one row a month. Readers follow the manifest, so a run that dies midway leaves every month as
it was. Pairs may be as many as the input's rows: they are listed and compared by all tasks, and only the manifest's months are broadcast.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import columns as C

_MANIFEST = "month_label string, file string, run string, epoch long"
_FILES = "month_label string, file string, run string"


def _found(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows at ``path``; none if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, schema.split(", "))])


def newest_runs(spark: SparkSession, path: str) -> DataFrame:
    """(month_label, run) of the newest run of each month, one row a month; empty if there is no table yet."""
    rows = _found(spark, f"{path}/manifest", _MANIFEST)
    return rows.groupBy("month_label").agg(F.max(F.struct("epoch", "run")).alias("n")).select("month_label", "n.run")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(month_label, run, file): the files that the newest run of each month was built from. Tables of before name them in the manifest itself."""
    newest = newest_runs(spark, path)
    runs = [r.run for r in newest.select("run").distinct().collect()]
    listed = _found(spark, f"{path}/files", _FILES).filter(F.col("run").isin(runs))
    named = _found(spark, f"{path}/manifest", _MANIFEST).filter("file is not null").select("month_label", "file", "run")
    return listed.unionByName(named).join(F.broadcast(newest), ["month_label", "run"])


def _pairs(rows: DataFrame, file: str, date: str) -> DataFrame:
    """(month_label, file) of each row that has both."""
    return rows.select(C.month_label(F.col(date)).alias("month_label"), F.col(file).cast("string").alias("file")).filter("month_label is not null and file is not null")


def _dealt(pairs: DataFrame, tasks: int | None) -> DataFrame:
    return pairs.repartition(tasks, "month_label", "file") if tasks and tasks > 1 else pairs


def changed_months(rows: DataFrame, path: str, file: str, date: str = "count_date", tasks: int | None = None) -> list[str]:
    """Months whose files in ``rows`` are not those of the manifest: new, late or withdrawn files. Only dates and file ids are read. ``tasks`` as in ``refresh``."""
    now, then = _pairs(rows, file, date), manifest(rows.sparkSession, path).select("month_label", "file")
    if then.isEmpty():
        return sorted(r.month_label for r in now.select("month_label").distinct().collect())
    both = now.withColumn("side", F.lit(1)).unionByName(then.withColumn("side", F.lit(2)))
    sides = _dealt(both, tasks).groupBy("month_label", "file").agg(F.bit_or("side").alias("sides"))
    return sorted(r.month_label for r in sides.filter("sides <> 3").select("month_label").distinct().collect())


def refresh(rows: DataFrame, path: str, file: str, build: Callable[[DataFrame], DataFrame] | None = None, date: str = "count_date", months: list[str] | None = None, tasks: int | None = None) -> list[str]:
    """Rebuilds the changed months (or those given) with ``build`` of their rows, which must keep the date column; returns them.

    Rows without a date belong to no month and are left out; rows without a file id are built with their month but never make it change. Pairs of file and month are
    combined before they are shuffled; where a file has few rows of a month, so that pairs are nearly as many as rows, ``tasks`` (``core.tasks_for``) deals them
    uncombined among that many tasks, so that one holds as many however large the table is.
    """
    spark = rows.sparkSession
    months = changed_months(rows, path, file, date, tasks) if months is None else months
    if not months:
        return []
    run, epoch = uuid.uuid4().hex, time.time_ns()
    month = C.month_label(F.col(date))
    own = rows.filter(month.isin(months))
    built = (build(own) if build else own).withColumn("month_label", month)
    built.hint("rebalance", "month_label").write.partitionBy("month_label").parquet(f"{path}/data/run={run}")
    _dealt(_pairs(own, file, date), tasks).distinct().write.parquet(f"{path}/files/run={run}")
    spark.createDataFrame([(m, None, run, epoch) for m in months], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return months


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table: of each month, the rows of its newest run. Only those runs' folders are listed."""
    newest = newest_runs(spark, path)
    runs = [r.run for r in newest.select("run").distinct().collect()]
    if not runs:
        raise ValueError(f"no months at {path}")
    data = spark.read.option("partitionColumnTypeInference.enabled", False).option("basePath", f"{path}/data").parquet(*[f"{path}/data/run={r}" for r in runs])
    return data.join(F.broadcast(newest), ["month_label", "run"], "left_semi").drop("run")
