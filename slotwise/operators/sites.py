"""Site dimension, rankings and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core, ordered



def site_names(*sources: DataFrame) -> DataFrame:
    """The smallest name of each site over several stores."""
    return reduce(DataFrame.unionByName, [s.select("site_id", "site_name") for s in sources]).groupBy("site_id").agg(F.min("site_name").alias("site_name"))


def with_site_name(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names, "site_id", "left").withColumn("site_name", F.coalesce("site_name", F.col("site_id").cast("string")))


def orphans(facts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, n_rows) of the facts whose key the dimension lacks; facts are added up by key before the join."""
    return facts.groupBy(key).agg(F.count("*").alias("n_rows")).join(known.select(key), key, "left_anti")


# The box (south, north, west, east) outside which a lookup's place is taken to be wrong.
LOOKUP_BOX = (-40.0, -33.0, 140.0, 150.0)


def best_site_lookup(lookups: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row of the lookups a site, whole: of those with a place in the box, the one with the longest name (ties: the earlier lookup, then the smaller name and place). Overrides win, name and place each.

    ``lookups``: site_id, site_name, latitude, longitude, lookup_order.
    """
    south, north, west, east = LOOKUP_BOX
    placed = lookups.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east)).withColumn("site_name", F.coalesce("site_name", F.lit("")))
    best = F.min(F.struct(-F.length("site_name"), "lookup_order", "site_name", "latitude", "longitude")).alias("b")
    out = placed.groupBy("site_id").agg(best).select("site_id", "b.site_name", "b.latitude", "b.longitude")
    if overrides is None:
        return out
    o = overrides.select("site_id", *[F.col(c).alias(f"o_{c}") for c in ("site_name", "latitude", "longitude")])
    moved = F.col("o_latitude").isNotNull() & F.col("o_longitude").isNotNull()
    place = [F.when(moved, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("latitude", "longitude")]
    return out.join(o, "site_id", "left").select("site_id", F.coalesce("o_site_name", "site_name").alias("site_name"), *place)


def valid_coordinates(sites: DataFrame, box: tuple[float, float, float, float] = (-39.5, -36.0, 143.0, 147.5)) -> DataFrame:
    """Sites inside (south, north, west, east)."""
    return sites.filter(F.col("latitude").between(box[0], box[1]) & F.col("longitude").between(box[2], box[3]))


def site_peak_slot(obs: DataFrame, asc: bool = False) -> DataFrame:
    """The 15 minutes of the highest (lowest) average of each site; ties by time."""
    bins = obs.groupBy("site_id", "time_bin").agg(F.avg("volume_15m").alias("avg_volume"))
    return core.top_per_group(bins, "site_id", "avg_volume", "time_bin", asc=asc)


def site_rankings(sm: DataFrame) -> DataFrame:
    """Totals, months, extremes and best month of each site; rank, share, cumulative share and band."""
    v = F.col("month_site_volume")
    top_month = F.max_by("month_label", F.struct(v, -F.regexp_replace("month_label", "-", "").cast("int")))
    out = sm.groupBy("site_id").agg(F.sum(v).alias("total_volume"), F.count("*").alias("months_present"), F.min("month_label").alias("first_month"), F.max("month_label").alias("last_month"), F.avg(v).alias("avg_monthly_volume"), F.max(v).alias("max_monthly_volume"), top_month.alias("best_month"))
    ranked = ordered.ranked(out, "total_volume", "site_id").withColumn("percent_of_network", C.pct(F.col("total_volume"), F.col("all_volume")))
    return ranked.withColumns({"cumulative_percent": C.pct(F.col("cumulative_volume"), F.col("all_volume")), "percentile_band": C.percentile_band(F.col("rank"), F.col("all_rows"))}).drop("all_rows", "all_volume")


def monthly_site_rank(sm: DataFrame) -> DataFrame:
    month = Window.partitionBy("month_label")
    return sm.withColumns({"month_rank": F.rank().over(month.orderBy(F.desc("month_site_volume"))), "sites_in_month": F.count("*").over(month)})


def concentration_curve(site_totals: DataFrame) -> DataFrame:
    return ordered.running_share(site_totals, "total_volume", "site_id").drop("all_rows", "all_volume")


def concentration_milestones(site_totals: DataFrame, targets: list[float]) -> DataFrame:
    """The fewest sites that hold each share: the rank at which the running share reaches it."""
    run = ordered.running_share(site_totals, "total_volume", "site_id")
    before = F.when(F.col("rank") > 1, C.pct(F.col("cumulative_volume") - F.col("total_volume"), F.col("all_volume")))
    return run.select(F.explode(ordered.crossed(before, F.col("cumulative_share_pct"), targets)).alias("target_pct"), F.col("rank").alias("sites_needed"))


def growth_by_year(obs: DataFrame) -> DataFrame:
    years = obs.groupBy("site_id", F.year("count_date").alias("y")).agg(F.sum("volume_15m").alias("v"))
    out = years.groupBy("site_id").agg(F.min("y").alias("first_year"), F.min_by("v", "y").alias("first_year_volume"), F.max("y").alias("last_year"), F.max_by("v", "y").alias("last_year_volume")).filter("first_year < last_year")
    change = F.col("last_year_volume") - F.col("first_year_volume")
    return out.withColumns({"absolute_change": change, "pct_change": F.round(C.pct(change, F.col("first_year_volume")), 2)})


def growth_first_last_12(sm: DataFrame, floor: float) -> DataFrame:
    """Averages over the network's first and last 12 months; sites with a first average under ``floor`` are left out."""
    months = sm.select("month_label").distinct().withColumns({"a": F.row_number().over(Window.orderBy("month_label")), "z": F.row_number().over(Window.orderBy(F.desc("month_label")))}).filter("a <= 12 or z <= 12")
    own = sm.join(F.broadcast(months), "month_label").groupBy("site_id").agg(F.avg(F.when(F.col("a") <= 12, F.col("month_site_volume"))).alias("first_12_avg"), F.avg(F.when(F.col("z") <= 12, F.col("month_site_volume"))).alias("last_12_avg"))
    change = F.col("last_12_avg") - F.col("first_12_avg")
    return own.filter(F.col("first_12_avg") >= floor).withColumns({"absolute_change": change, "growth_pct": C.pct(change, F.col("first_12_avg"))})


def growth_own_months(sm: DataFrame, floor: float | None = None) -> DataFrame:
    """Averages over each site's own first and last 12 months, from one array a site; with ``floor``, only sites where both are above it."""
    months = F.transform(F.array_sort(F.collect_list(F.struct("month_label", "month_site_volume"))), lambda m: m["month_site_volume"])
    mean = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v) / F.size(a)
    ends = sm.groupBy("site_id").agg(months.alias("m")).select("site_id", mean(F.slice("m", 1, 12)).alias("first_12_avg"), mean(F.slice("m", -F.least(F.size("m"), F.lit(12)), 12)).alias("last_12_avg"))
    change = F.col("last_12_avg") - F.col("first_12_avg")
    out = ends.withColumns({"absolute_growth": change, "growth_pct": C.pct(change, F.col("first_12_avg"))})
    return out if floor is None else out.filter((F.col("first_12_avg") > floor) & (F.col("last_12_avg") > floor))


def site_features(sm: DataFrame) -> DataFrame:
    v = F.col("month_site_volume")
    out = sm.groupBy("site_id").agg(F.count("*").alias("months"), F.sum(v).alias("total_volume"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.max(v).alias("max"), F.min(v).alias("min"))
    return out.withColumns({"cv": C.safe_div(F.col("sd"), F.col("mean")), "max_to_mean": C.safe_div(F.col("max"), F.col("mean"))})


def site_years(sm: DataFrame) -> DataFrame:
    """Yearly profile of a site's months."""
    v = F.col("month_site_volume")
    return sm.groupBy(F.substring("month_label", 1, 4).cast("int").alias("year")).agg(F.sum(v).alias("annual_volume"), F.count(v).alias("months_seen"), F.avg(v).alias("avg_month_volume"))


def site_months_of_year(sm: DataFrame) -> DataFrame:
    """Month-of-year profile of a site's months."""
    v = F.col("month_site_volume")
    return sm.groupBy(F.substring("month_label", 6, 2).cast("int").alias("month_of_year")).agg(
        F.avg(v).alias("avg_month_volume"), F.median(v).alias("median_month_volume"), F.max(v).alias("max_month_volume"), F.countDistinct(F.substring("month_label", 1, 4)).alias("years_seen")
    )


def commercial_value(sm: DataFrame, floor: float = 1000.0) -> DataFrame:
    """100 x (.55 volume + .25 growth + .20 stability), each a percent rank; growth is absolute, 0 for sites under ``floor``; a missing stability counts .5."""
    f = site_features(sm).join(growth_own_months(sm, floor).select("site_id", "absolute_growth", "growth_pct"), "site_id", "left").withColumn("absolute_growth", F.coalesce("absolute_growth", F.lit(0.0)))
    stability = F.coalesce(1 - C.pct_rank(F.col("cv")), F.lit(0.5))
    score = 100 * (0.55 * C.pct_rank(F.col("total_volume")) + 0.25 * C.pct_rank(F.col("absolute_growth")) + 0.20 * stability)
    return f.withColumn("score", score).select("site_id", "total_volume", "absolute_growth", "growth_pct", "cv", "score")


def lifecycle(sm: DataFrame, floor: float = 1000.0) -> DataFrame:
    """Growth above the 80th percentile of absolute growth, decline below its 20th, volatile above the 80th of cv, else stable; of sites over ``floor``."""
    f = growth_own_months(sm, floor).join(site_features(sm).select("site_id", "mean", "cv"), "site_id")
    cuts = f.agg(F.percentile("absolute_growth", F.lit(0.8)).alias("g80"), F.percentile("absolute_growth", F.lit(0.2)).alias("g20"), F.percentile("cv", F.lit(0.8)).alias("c80"))
    kind = C.first_match((F.col("absolute_growth") > F.col("g80"), "Growth"), (F.col("absolute_growth") < F.col("g20"), "Decline"), (F.col("cv") > F.col("c80"), "Volatile"), otherwise="Stable")
    return f.crossJoin(F.broadcast(cuts)).select("site_id", "absolute_growth", "cv", F.col("mean").alias("mean_volume"), kind.alias("lifecycle"))


def lifecycle_summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("lifecycle").agg(F.count("*").alias("sites"), F.avg("absolute_growth").alias("avg_monthly_growth"), F.avg("cv").alias("avg_cv"), F.avg("mean_volume").alias("avg_mean_volume"))


def archetype_scores(sm: DataFrame) -> DataFrame:
    """Percent ranks, 0..100: scale, stability, volatility, growth, spike. A null counts as 0 before it is inverted."""
    f = site_features(sm).join(growth_own_months(sm).select("site_id", "growth_pct"), "site_id")
    rank = lambda c: 100 * F.coalesce(C.pct_rank(F.col(c)), F.lit(0.0))
    scores = {"scale_score": rank("total_volume"), "volatility_score": rank("cv"), "growth_score": rank("growth_pct"), "spike_score": rank("max_to_mean")}
    return f.withColumns(scores).withColumn("stability_score", 100 - F.col("volatility_score")).select("site_id", "total_volume", "scale_score", "stability_score", "volatility_score", "growth_score", "spike_score")


def archetype(scores: DataFrame) -> DataFrame:
    """Eleven classes; the first rule that holds gives the class. Names and cuts are fixed values."""
    scale, stability, volatility, growth, spike = (F.col(f"{n}_score") for n in ("scale", "stability", "volatility", "growth", "spike"))
    rules = [
        ((scale >= 90) & (stability >= 65), "Metropolitan Backbone"), ((scale >= 85) & (volatility >= 70), "High-Volume Volatile Corridor"), ((growth >= 85) & (scale >= 60), "Rising Growth Corridor"),
        ((volatility >= 85) & (spike >= 75), "Event / Disruption Sensitive Site"), ((scale >= 75) & (stability >= 80), "Reliable Exposure Corridor"), ((scale < 40) & (growth >= 80), "Emerging Local Growth Site"),
        ((scale < 35) & (stability >= 70), "Stable Low-Volume Local Site"), (volatility >= 75, "Unstable / Variable Site"), ((scale >= 70) & (stability >= 45), "Mature Urban Arterial"), (scale >= 45, "Balanced Metropolitan Site"),
    ]
    return scores.withColumn("archetype", C.first_match(*rules, otherwise="Secondary Connector Corridor"))


#: Weights of the scores in the composite indices.
INDEX_WEIGHTS = {
    "ooh_exposure_score": {"scale": 0.55, "stability": 0.25, "growth": 0.20},
    "traffic_transformation_index": {"volatility": 0.35, "growth": 0.30, "scale": 0.20, "spike": 0.15},
    "strategic_importance_score": {"scale": 0.45, "stability": 0.20, "growth": 0.20, "volatility": 0.15},
}


def archetype_indices(scores: DataFrame) -> DataFrame:
    return scores.withColumns({name: reduce(lambda a, b: a + b, [F.col(f"{s}_score") * w for s, w in weights.items()]) for name, weights in INDEX_WEIGHTS.items()})


def archetype_summary(classes: DataFrame) -> DataFrame:
    """Of each class, from scores with indices: sites, volume and its share, average scores and indices."""
    means = [f"{n}_score" for n in ("scale", "stability", "volatility", "growth")] + list(INDEX_WEIGHTS)
    out = classes.groupBy("archetype").agg(F.count("*").alias("sites"), F.sum("total_volume").alias("total_volume"), F.avg("total_volume").alias("avg_total_volume"), *[F.avg(c).alias(f"avg_{c}") for c in means])
    return out.withColumn("traffic_share_pct", C.pct(F.col("total_volume"), F.sum("total_volume").over(Window.partitionBy())))


def tiers(rk: DataFrame, cuts: list[tuple[int, str]], rest: str, name: str) -> DataFrame:
    """Sites grouped by rank: sites, volume, share of volume and of sites, and their ratio."""
    label = C.first_match(*[(F.col("rank") <= n, text) for n, text in cuts], otherwise=rest)
    out = rk.groupBy(label.alias(name)).agg(F.count("*").alias("sites"), F.sum("total_volume").alias("total_volume"))
    shares = out.withColumns({"traffic_share_pct": C.pct(F.col("total_volume"), F.sum("total_volume").over(Window.partitionBy())), "site_share_pct": C.pct(F.col("sites"), F.sum("sites").over(Window.partitionBy()))})
    return shares.withColumn("efficiency", C.safe_div(F.col("traffic_share_pct"), F.col("site_share_pct")))


def portfolio_simulation(rk: DataFrame, sizes: list[int]) -> DataFrame:
    """What the best n sites hold, for each n, and what each step adds; from the running volume at rank n (``ordered.ranked``), or at the last rank where there are fewer sites."""
    rank, rows = F.col("rank"), F.col("all_rows")
    met = F.filter(F.array(*map(F.lit, sizes)), lambda n: (n == rank) | ((rank == rows) & (n > rows)))
    held = rk.select(F.explode(met).alias("portfolio_size"), F.col("cumulative_volume").alias("captured_volume"), rank.cast("long").alias("sites"), F.col("all_volume"), rows.alias("all_sites"))
    before = Window.orderBy("portfolio_size")
    out = held.withColumns({"captured_share_pct": C.pct(F.col("captured_volume"), F.col("all_volume")), "site_share_pct": C.pct(F.col("sites"), F.col("all_sites"))})
    out = out.withColumns({
        "incremental_sites": F.col("sites") - F.coalesce(F.lag("sites").over(before), F.lit(0)), "incremental_volume": F.col("captured_volume") - F.coalesce(F.lag("captured_volume").over(before), F.lit(0)),
        "efficiency_ratio": C.safe_div(F.col("captured_share_pct"), F.col("site_share_pct")), "remaining_volume": F.col("all_volume") - F.col("captured_volume"),
    })
    return out.drop("all_volume", "all_sites")


def revenue_scenarios(rk: DataFrame, sizes: list[int], cpms: list[float], uses: list[float], cost_per_site: float) -> DataFrame:
    """Revenue, cost, profit, return and break-even rate of every size, rate and use. The three lists are literals."""
    spark = rk.sparkSession
    held = portfolio_simulation(rk, sizes).select("portfolio_size", "sites", "captured_volume")
    rates = spark.createDataFrame([(float(x),) for x in cpms], "cpm double").crossJoin(spark.createDataFrame([(float(x),) for x in uses], "utilisation double"))
    out = held.crossJoin(F.broadcast(rates)).withColumns({"revenue": F.col("captured_volume") / F.lit(1000.0) * F.col("cpm") * F.col("utilisation"), "cost": F.col("sites") * F.lit(float(cost_per_site))})
    return out.withColumns({"profit": F.col("revenue") - F.col("cost"), "roi_pct": C.pct(F.col("revenue") - F.col("cost"), F.col("cost")), "break_even_cpm": C.safe_div(F.col("cost") * 1000, F.col("captured_volume") * F.col("utilisation"))})


def traffic_band(site_totals: DataFrame) -> DataFrame:
    p = 100 * C.pct_rank(F.col("total_volume"))
    out = site_totals.withColumns({"volume_percentile": p, "ratio_to_max": C.safe_div(F.col("total_volume"), F.max("total_volume").over(Window.partitionBy()))})
    r = F.col("ratio_to_max")
    return out.withColumns({
        "volume_band": C.first_match((F.col("volume_percentile") >= 95, "red"), (F.col("volume_percentile") >= 80, "orange"), (F.col("volume_percentile") >= 50, "yellow"), otherwise="green"),
        "heat": C.first_match((r >= 0.85, "red"), (r >= 0.70, "orange"), (r >= 0.55, "amber"), otherwise="green"),
    })


def exposure_metrics(site_totals: DataFrame, years: float, peak_hour_factor: float = 0.1) -> DataFrame:
    """A total over ``years`` as volume a year, a day, and in the peak hour (a part of the rounded day), each rounded to whole counts (halves to the even one)."""
    whole = lambda c: F.bround(c).cast("bigint")
    total = F.col("total_volume")
    out = site_totals.withColumns({"annual_volume": whole(total / F.lit(float(years))), "daily_volume": whole(total / F.lit(float(years) * 365.25))})
    return out.withColumn("peak_hour_volume", whole(F.col("daily_volume") * F.lit(float(peak_hour_factor))))


#: Tiers of traffic by rank.
STRATEGY_TIERS = [(50, "Tier 1: Core"), (100, "Tier 2: Strategic"), (500, "Tier 3: Major"), (1000, "Tier 4: Broad Network")]
LAST_TIER = "Tier 5: Long Tail"


def opportunity_tier(rk: DataFrame) -> DataFrame:
    r = F.col("rank")
    return rk.select("site_id", "total_volume", "rank", C.first_match((r <= 10, "Elite Top 10"), (r <= 25, "Premium Top 25"), (r <= 50, "Strategic Top 50"), otherwise="High-Value Top 100").alias("tier"))


#: Tiers of the ranking and what a thousand movements bring in each.
TIER_RATES = [(100, "Top 100", 16), (500, "101–500", 12), (1000, "501–1000", 8), (2000, "1001–2000", 5), (None, "2001+", 3)]


def tier_revenue(rk: DataFrame, cost_per_site: float, tiers_: list[tuple[int | None, str, float]] = TIER_RATES) -> DataFrame:
    """Sites, volume, rate, revenue, cost, profit and return of each tier; the last tier has no bound."""
    label = C.first_match(*[(F.col("rank") <= n, text) for n, text, _ in tiers_[:-1]], otherwise=tiers_[-1][1])
    rate = C.first_match(*[(F.col("tier") == text, F.lit(float(r))) for _, text, r in tiers_])
    out = rk.groupBy(label.alias("tier")).agg(F.count("*").alias("sites"), F.sum("total_volume").alias("volume")).withColumn("cpm", rate)
    out = out.withColumns({"revenue": F.col("volume") / F.lit(1000.0) * F.col("cpm"), "cost": F.col("sites") * F.lit(float(cost_per_site))})
    return out.withColumns({"profit": F.col("revenue") - F.col("cost"), "roi_pct": C.pct(F.col("revenue") - F.col("cost"), F.col("cost"))})


EARTH = 6_371_000


def nearest_within(points: DataFrame, features: DataFrame, metres: float, point_key: str = "site_id", feature_key: str = "feature_id") -> DataFrame:
    """The nearest feature within ``metres`` of each point (ties: the smaller key), anywhere on the globe.

    Places are points on the unit sphere, cut into cubes as wide as the distance: whatever lies within it stands in one of the 27 cubes around, also at the
    poles and across the 180th meridian. Rows without a place have no neighbours. Rows of one place count once (of features, the smallest key); the least distance of
    each place is found first, then the keys that have it, so pairs are only added up where they arise: none is sorted or shuffled.
    """
    size = metres / EARTH
    here = ["latitude", "longitude"]

    def cubes(df: DataFrame) -> DataFrame:
        a, b = F.radians("latitude"), F.radians("longitude")
        sides = {"cx": F.cos(a) * F.cos(b), "cy": F.cos(a) * F.sin(b), "cz": F.sin(a)}
        return df.withColumns({c: F.floor(v / size) for c, v in sides.items()})

    placed = lambda df: df.filter("latitude is not null and longitude is not null")
    # dealt by cube (merge) in any case: one side in every task, as Spark has it for few bytes, would leave the pairs of all to few tasks
    f = cubes(placed(features).groupBy(*here).agg(F.min(feature_key).alias(feature_key))).withColumnsRenamed({"latitude": "flat", "longitude": "flon"})
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", (i // 9 - 1, i // 3 % 3 - 1, i % 3 - 1), strict=True)]) for i in range(27)])
    half = lambda a, b: F.pow(F.sin((F.radians(a) - F.radians(b)) / 2), 2)
    h = half(F.col("latitude"), F.col("flat")) + F.cos(F.radians("latitude")) * F.cos(F.radians("flat")) * half(F.col("longitude"), F.col("flon"))

    def near(places: DataFrame) -> DataFrame:
        p = cubes(places).withColumn("s", F.explode(steps)).withColumns({f"c{n}": F.col(f"c{n}") + F.col(f"s.{n}") for n in "xyz"}).drop("s")
        return p.join(f.hint("merge"), ["cx", "cy", "cz"]).withColumn("metres", 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))).filter(F.col("metres") <= metres)

    least = near(placed(points).select(*here).distinct()).groupBy(*here).agg(F.min("metres").alias("least"))
    won = near(least).filter(F.col("metres") == F.col("least")).groupBy(*here).agg(F.min(feature_key).alias(feature_key), F.min("metres").alias("metres"))
    return placed(points).select(point_key, *here).join(won, here).select(point_key, feature_key, "metres")
