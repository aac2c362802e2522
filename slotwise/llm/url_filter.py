"""URL rules by a sort-merge range join, with DataFrame functions only.

A rule (host, path) is the prefix ``reversed host labels + path`` of canonical keys, so an interval: from the prefix
itself to the prefix followed by the byte FF, which no UTF-8 text holds. A url has one key for each of its enclosing
hosts (at most as many labels as the longest rule has). Keys and the ends of intervals are sorted together and swept:
an interval's start pushes its rule, its end pops it, which leaves the rule that encloses it. As every end carries the
rule below it, the top of the stack at a url is what the last end before it carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; '' for null or without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) from a list."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _reversed(labels: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def _intervals(rules: DataFrame) -> DataFrame:
    """One event for each end of each rule's interval: node, place (binary) and the rule then on top (null: none)."""
    single = rules.filter("host <> '' and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keyed = single.select(_reversed(F.split("host", r"\.", -1)).alias("node"), "path", F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length")).alias("top"))
    # A rule's parent is its longest proper prefix that is a rule of the same host.
    prefixes = keyed.filter("length(path) > 0").select("node", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n")).select("node", F.col("path").alias("child"), F.expr("left(path, n)").alias("path"), "n")
    parents = prefixes.join(keyed, ["node", "path"]).groupBy("node", F.col("child").alias("path")).agg(F.max_by("top", "n").alias("below"))
    both = keyed.join(parents, ["node", "path"], "left")
    start = F.struct(F.encode("path", "utf-8").alias("place"), F.col("top").alias("top"))
    end = F.struct(F.concat(F.encode("path", "utf-8"), F.unhex(F.lit("FF"))).alias("place"), F.col("below").alias("top"))
    return both.select("node", F.explode(F.array(start, end)).alias("e")).select("node", "e.place", "e.top")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", parts: int = 1000) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null: none fits) and ``verdict`` (the rule's, else ``default``).

    A rule fits its host and all subdomains where the path starts with the rule's; of those that fit, the longest
    wins (host and path together; then the longer host, then the larger text). A rule given twice with different verdicts has the
    larger one, block. Null or odd urls have empty host and path, so no rule. Columns of ``pages`` with these four
    names are replaced; others pass, whatever their names. Equal urls are judged once. A host with more than one in ``parts`` of all different urls is dealt to
    several sweeps of that size, each with that host's rules; there are fewer than ``parts`` such hosts, so their list is broadcast. Very long urls are judged whole. Repeated
    rows stay, judged alike; without rules every url has the default; an empty table stays empty.
    """
    depth = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    named = pages.select(F.struct(*names).alias("row"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = named.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    widest = F.greatest(F.lit(1), F.size(labels) - F.lit(depth) + 1)
    nodes = F.transform(F.sequence(widest, F.size(labels)), lambda i: _reversed(F.slice(labels, i, F.size(labels))))
    placed = urls.filter(F.lit(depth > 0) & (F.col("host") != "")).select("host", "path", F.explode(nodes).alias("node"))
    sizes = placed.groupBy("node").agg(F.count("*").alias("n"))
    most = sizes.agg((F.sum("n") / parts).alias("most"))
    hot = F.broadcast(sizes.crossJoin(F.broadcast(most)).filter("n > most").select("node", F.ceil(F.col("n") / F.col("most")).cast("int").alias("sweeps")))
    sweeps = F.coalesce("sweeps", F.lit(1))
    events = _intervals(rules).join(hot, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), sweeps - 1)))
    probes = placed.join(hot, "node", "left").select("host", "path", "node", F.pmod(F.xxhash64("host", "path"), sweeps).cast("int").alias("salt"))
    top = F.col("top")
    merged = events.select("node", "salt", "place", F.lit(0).alias("probe"), F.struct(top.alias("t")).alias("event"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")).unionByName(
        probes.select("node", "salt", F.encode("path", "utf-8").alias("place"), F.lit(1).alias("probe"), "host", "path"), allowMissingColumns=True
    )
    sweep = Window.partitionBy("node", "salt").orderBy("place", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = merged.withColumn("event", F.last("event", ignorenulls=True).over(sweep)).filter("probe = 1 and event.t is not null")
    fit = F.col("event.t")
    best = swept.groupBy("host", "path").agg(F.max(F.struct(F.length(fit["rule"]).alias("n"), fit["host_length"].alias("h"), fit["rule"].alias("rule"), fit["verdict"].alias("verdict"))).alias("best"))
    judged = named.join(best, ["host", "path"], "left")
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
