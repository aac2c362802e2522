"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: `u` has 52 bits: the first 13 hexadecimal digits of an MD5.
_UNIT = float(2**52)


def _uniform(*parts: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(_UNIT)


def repetition_rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, rate): the mean number of copies of each document of a source.

    With ``weights``, a source's share of the output is its weight over the sum of weights (a source without one has
    weight 0); without, its share goes as its number of rows to the power ``temperature``. The output has about as many rows as the input.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        weighted = counts.join(given, counts.source.eqNullSafe(given.name), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = weighted.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    return weighted.crossJoin(total).select("source", F.coalesce(F.expr("try_divide(w / all_w * all_n, n)"), F.lit(0.0)).alias("rate"))


def _distribution(rate: float) -> tuple[int, list[float]]:
    """(n, distribution function at n, n + 1, n + 2, ...) of a Poisson variable, far enough into its tails that 52 bits see no more; linear in its terms.

    From a rate of 500 on, n is not 0 (exp(-rate) vanishes from 745 on): the terms start with 1 twelve standard deviations under the mean
    and are divided by their sum.
    """
    spread = 12 * math.sqrt(rate) + 14
    most = math.ceil(rate + spread)
    least, p = (0, math.exp(-rate)) if rate < 500 else (math.floor(rate - spread), 1.0)
    sums = [p]
    for k in range(least + 1, most + 1):
        p = p * rate / k
        sums.append(sums[-1] + p)
    return least, sums if rate < 500 else [c / sums[-1] for c in sums]


def _inverse(rate: Column) -> Column:
    @F.arrow_udf(returnType="struct<least int, cdf array<double>>")
    def tables(rates: pa.Array) -> pa.Array:
        rows = [_distribution(r) for r in rates.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.float64()))], ["least", "cdf"])

    return tables(rate)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5, seed: int = 17, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """Each row ``count`` times (column ``copy`` from 1), ``count`` the Poisson quantile of a hash of id and seed; in a global random order.

    The mean of the Poisson distribution is the source's rate (see ``repetition_rates``), however large. Repeated rows of one id have equal
    counts; a row with a null id is hashed by its text. A null source is a source of its own. An empty table gives an empty one.
    Other columns pass through, whatever their names; a column named ``copy`` is replaced.

    The rates are counted first, from the source column alone. Sources' distribution functions are one row a source; they are broadcast where they take
    ``broadcast_bytes`` at most, so that documents are not dealt by source; else joined by sorting, and Spark splits a hot source. Then the rows are dealt once by a
    hash of id, text, copy and seed and sorted by it within each partition, which is a random order of the whole; it depends on the number of shuffle partitions.
    """
    names = [c for c in docs.columns if c != "copy"]
    rates = repetition_rates(docs, source_col, weights, temperature).select("source", _inverse(F.col("rate")).alias("d")).select("source", "d.least", "d.cdf")
    size = rates.agg(F.sum(F.size("cdf") * 8 + F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    rates = F.broadcast(rates) if size <= broadcast_bytes else rates.hint("merge")
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(F.struct(*names).alias("row"), F.col(source_col).alias("of"), key.alias("key"), F.xxhash64(text_col).alias("text_hash"), _uniform(key, F.lit(str(seed))).alias("u"))
    counted = rows.join(rates, F.col("of").eqNullSafe(F.col("source"))).select("row", "key", "text_hash", (F.col("least") + F.size(F.filter("cdf", lambda c: c < F.col("u")))).alias("n"))
    copied = counted.filter("n > 0").select("row", "key", "text_hash", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    placed = copied.select("row", "copy", F.xxhash64("key", "text_hash", "copy", F.lit(seed)).alias("at"))
    return placed.repartition("at").sortWithinPartitions("at").select(*[F.col(f"row.`{c}`").alias(c) for c in names], "copy")
