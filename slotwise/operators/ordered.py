"""Ranks, running sums and quantiles of tables of any size, by ranges of the value: no window without keys, no value list in one buffer.

Cuts between ranges are chosen from approximate quantiles, then used as literals, so a row's range is the same however often it is computed. Ranges are
ranked and summed by themselves; the few range totals are added up and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C

PER_RANGE = 1_000_000


def cuts(df: DataFrame, value: str, per_range: int = PER_RANGE) -> list[float]:
    """Values that part the table in ranges of about ``per_range`` rows (equal values are never parted); none for a small table."""
    n = df.agg(F.count(value)).first()[0]
    ranges = math.ceil(n / per_range)
    if ranges < 2:
        return []
    found = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    return sorted({float(c) for c in found})


def _range(value: str, at: list[float]) -> Column:
    """The number of cuts under the value; a null value lies in the last range."""
    if not at:
        return F.lit(0)
    return F.when(F.col(value).isNull(), len(at)).otherwise(F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c < F.col(value))))


def _offsets(ranged: DataFrame, desc: bool, **sums: Column) -> DataFrame:
    """(range, and of each sum what the ranges before hold, as before_<name>, and all ranges, as all_<name>): a row a range."""
    per = ranged.groupBy("_range").agg(*[c.alias(f"_{n}") for n, c in sums.items()])
    order = Window.orderBy(F.desc("_range") if desc else F.asc("_range"))
    none, every = F.lit(0), Window.partitionBy()
    names = {f"before_{n}": F.coalesce(F.sum(f"_{n}").over(order.rowsBetween(Window.unboundedPreceding, -1)), none) for n in sums}
    return per.withColumns(names | {f"all_{n}": F.sum(f"_{n}").over(every) for n in sums}).select(F.col("_range").alias("_r"), *names, *[f"all_{n}" for n in sums])


def ranked(df: DataFrame, value: str, tie: str, at: list[float] | None = None) -> DataFrame:
    """By falling ``value`` (nulls last), ties by ``tie``: ``rank``, ``cumulative_volume``, and the table's ``all_rows`` and ``all_volume``.

    Rows of one value stand in one range, so a value that very many rows share makes a large range; it is sorted, with spill, and not held.
    """
    at = cuts(df, value) if at is None else at
    # a null is last, so beyond the smallest value's range
    ranged = df.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(_range(value, at)))
    own = Window.partitionBy("_range").orderBy(F.desc_nulls_last(value), tie)
    offsets = _offsets(ranged, True, rows=F.count("*"), volume=F.sum(value))
    inside = ranged.withColumns({"rank": F.row_number().over(own), "cumulative_volume": F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    joined = inside.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    return joined.withColumns({"rank": (F.col("rank") + F.col("before_rows")).cast("int"), "cumulative_volume": F.col("cumulative_volume") + F.col("before_volume")}).drop("_range", "_r", "before_rows", "before_volume")


def pct_rank(df: DataFrame, value: str, name: str = "pct_rank", at: list[float] | None = None) -> DataFrame:
    """With the average rank of ties over the number of values (null for null), as ``columns.pct_rank`` has it. Equal values are counted first, so a hot value is one row."""
    at = cuts(df, value) if at is None else at
    ranged = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_range", _range("_v", at))
    own = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    offsets = _offsets(ranged, False, rows=F.sum("_n"))
    upto = ranged.withColumn("_upto", F.sum("_n").over(own)).join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    ranks = upto.select("_v", ((F.col("before_rows") + F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("all_rows")).alias(name))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def crossed(before: Column, now: Column, targets: Sequence[float]) -> Column:
    """The targets that a rising running value reaches at this row: over ``before`` (null at the first row) and up to ``now``."""
    wanted = F.array(*[F.lit(float(t)) for t in targets])
    return F.filter(wanted, lambda t: (t <= now) & F.coalesce(t > before, F.lit(True)))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], bins: int = 4096) -> list[float | None]:
    """Exact quantiles (linear between neighbours, as ``percentile``), in memory bounded by ``bins`` a share: histograms are refined about the wanted ranks until a bin holds one value.

    Passes go as the spread of doubles allows, most often two or three; nulls are left out; without values all are null.
    """
    v = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    known: dict[int, float] = {}
    # (least value, largest value, rows before): an interval for each wanted rank
    open_ = {r: (low, high, 0) for p in places for r in (math.floor(p), math.ceil(p))}
    while open_:
        for r, (a, b, _) in list(open_.items()):
            if a == b:
                known[r] = a
                del open_[r]
        spans = sorted(set(open_.values()))
        if not spans:
            break
        bin_of = lambda a, b: F.least(F.lit(bins - 1), F.floor((F.col("v") - a) / ((b - a) / bins) if b - a < float("inf") else (F.col("v") / 2 - a / 2) / (b / 2 / bins - a / 2 / bins))).cast("int")
        tags = F.array_compact(F.array(*[F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("span"), bin_of(a, b).alias("bin"))) for i, (a, b, _) in enumerate(spans)]))
        found = v.select("v", F.explode(tags).alias("t")).groupBy("t.span", "t.bin").agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for i, (a, b, before) in enumerate(spans):
            own = sorted((r.a, r.b, r.n) for r in found if r.span == i)
            for rank in [r for r, s in open_.items() if s == (a, b, before)]:
                seen = before
                for first, last, rows in own:
                    if rank < seen + rows:
                        open_[rank] = (first, last, seen)
                        break
                    seen += rows
    return [known[math.floor(p)] + (known[math.ceil(p)] - known[math.floor(p)]) * (p - math.floor(p)) for p in places]


def running_share(df: DataFrame, value: str, tie: str) -> DataFrame:
    """``ranked`` with the cumulative share of the volume and of the rows, in per cent."""
    out = ranked(df, value, tie)
    return out.withColumns({"cumulative_share_pct": C.pct(F.col("cumulative_volume"), F.col("all_volume")), "site_share_pct": C.pct(F.col("rank"), F.col("all_rows"))})
