"""Queries: growth, scores, classes, portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators import core
from slotwise.operators import exports as E
from slotwise.operators import sites as S
from slotwise.plans.base import add
from slotwise.plans.profiles import _r6
from slotwise.plans.rankings import rk

add("growth_first_last_12", lambda t: S.growth_first_last_12(t.sm, 100.0), ", m AS (SELECT month_label, row_number() OVER (ORDER BY month_label) AS a, row_number() OVER (ORDER BY month_label DESC) AS z FROM (SELECT DISTINCT month_label FROM sm)), x AS (SELECT site_id, avg(month_site_volume) FILTER (a <= 12) AS first_12_avg, avg(month_site_volume) FILTER (z <= 12) AS last_12_avg FROM sm JOIN m USING (month_label) GROUP BY 1) SELECT *, last_12_avg - first_12_avg AS absolute_change, (last_12_avg - first_12_avg) * 100 / first_12_avg AS growth_pct FROM x WHERE first_12_avg >= 100")
_OWN = ", om AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY month_label) AS a, row_number() OVER (PARTITION BY site_id ORDER BY month_label DESC) AS z FROM sm), og AS (SELECT site_id, avg(month_site_volume) FILTER (a <= 12) AS first_12_avg, avg(month_site_volume) FILTER (z <= 12) AS last_12_avg FROM om GROUP BY 1), g AS (SELECT *, last_12_avg - first_12_avg AS absolute_growth, (last_12_avg - first_12_avg) * 100 / nullif(first_12_avg, 0) AS growth_pct FROM og), gf AS (SELECT * FROM g WHERE first_12_avg > 100 AND last_12_avg > 100)"
add("growth_own_months", lambda t: S.growth_own_months(t.sm, 100.0), _OWN + " SELECT * FROM gf")
_FEAT = _OWN + ", ft AS (SELECT site_id, count(*) AS months, sum(month_site_volume)::BIGINT AS total_volume, avg(month_site_volume) AS mean, median(month_site_volume)::DOUBLE AS median, stddev_samp(month_site_volume) AS sd, max(month_site_volume) AS max, min(month_site_volume) AS min, stddev_samp(month_site_volume) / avg(month_site_volume) AS cv, max(month_site_volume) / avg(month_site_volume) AS max_to_mean FROM sm GROUP BY 1), fg AS (SELECT ft.*, growth_pct FROM ft JOIN g USING (site_id))"
_PR = "(CASE WHEN {0} IS NOT NULL THEN (rank() OVER (ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY {0}) - 1) / 2::DOUBLE) / count({0}) OVER () END)"
add("site_features", lambda t: _r6(S.site_features(t.sm), "sd", "cv"), _FEAT + " SELECT * REPLACE (round(sd, 6) AS sd, round(cv, 6) AS cv) FROM ft")
add(
    "commercial_value",
    lambda t: _r6(core.top(S.commercial_value(t.sm, 100.0).withColumn("score", F.round("score", 6)), 25, "score", "site_id"), "cv"),
    _FEAT + ", cg AS (SELECT ft.*, coalesce(absolute_growth, 0) AS absolute_growth, growth_pct FROM ft LEFT JOIN gf USING (site_id)), x AS (SELECT site_id, total_volume, absolute_growth, growth_pct, round(cv, 6) AS cv, round(100 * (0.55::DOUBLE * " + _PR.format("total_volume")
    + " + 0.25::DOUBLE * " + _PR.format("absolute_growth") + " + 0.2::DOUBLE * coalesce(1 - " + _PR.format("cv") + ", 0.5)), 6) AS score FROM cg) SELECT *, row_number() OVER (ORDER BY score DESC, site_id)::INTEGER AS rank FROM x QUALIFY rank <= 25",
)
_LIFE = (
    _FEAT + ", lg AS (SELECT gf.*, ft.mean, ft.cv FROM gf JOIN ft USING (site_id)), k AS (SELECT quantile_cont(absolute_growth, 0.8) AS g80, quantile_cont(absolute_growth, 0.2) AS g20, quantile_cont(cv, 0.8) AS c80 FROM lg), "
    "lf AS (SELECT site_id, absolute_growth, cv, mean AS mean_volume, CASE WHEN absolute_growth > g80 THEN 'Growth' WHEN absolute_growth < g20 THEN 'Decline' WHEN cv > c80 THEN 'Volatile' ELSE 'Stable' END AS lifecycle FROM lg, k)"
)
add("lifecycle", lambda t: _r6(S.lifecycle(t.sm, 100.0), "cv"), _LIFE + " SELECT * REPLACE (round(cv, 6) AS cv) FROM lf")
add("lifecycle_summary", lambda t: _r6(S.lifecycle_summary(S.lifecycle(t.sm, 100.0)), "avg_monthly_growth", "avg_cv", "avg_mean_volume"), _LIFE + " SELECT lifecycle, count(*) AS sites, round(avg(absolute_growth), 6) AS avg_monthly_growth, round(avg(cv), 6) AS avg_cv, round(avg(mean_volume), 6) AS avg_mean_volume FROM lf GROUP BY 1")
_RULES = (
    "CASE WHEN scale_score >= 90 AND stability_score >= 65 THEN 'Metropolitan Backbone' WHEN scale_score >= 85 AND volatility_score >= 70 THEN 'High-Volume Volatile Corridor' WHEN growth_score >= 85 AND scale_score >= 60 THEN 'Rising Growth Corridor' "
    "WHEN volatility_score >= 85 AND spike_score >= 75 THEN 'Event / Disruption Sensitive Site' WHEN scale_score >= 75 AND stability_score >= 80 THEN 'Reliable Exposure Corridor' WHEN scale_score < 40 AND growth_score >= 80 THEN 'Emerging Local Growth Site' "
    "WHEN scale_score < 35 AND stability_score >= 70 THEN 'Stable Low-Volume Local Site' WHEN volatility_score >= 75 THEN 'Unstable / Variable Site' WHEN scale_score >= 70 AND stability_score >= 45 THEN 'Mature Urban Arterial' "
    "WHEN scale_score >= 45 THEN 'Balanced Metropolitan Site' ELSE 'Secondary Connector Corridor' END"
)
_SC = (
    _FEAT + ", s0 AS (SELECT site_id, total_volume, " + ", ".join(f"round(100 * coalesce({_PR.format(c)}, 0), 6) AS {n}_score" for c, n in (("total_volume", "scale"), ("cv", "volatility"), ("growth_pct", "growth"), ("max_to_mean", "spike")))
    + f" FROM fg), sc AS (SELECT *, 100 - volatility_score AS stability_score FROM s0), ar AS (SELECT *, {_RULES} AS archetype, scale_score * 0.55::DOUBLE + stability_score * 0.25::DOUBLE + growth_score * 0.2::DOUBLE AS ooh_exposure_score, "
    "volatility_score * 0.35::DOUBLE + growth_score * 0.3::DOUBLE + scale_score * 0.2::DOUBLE + spike_score * 0.15::DOUBLE AS traffic_transformation_index, scale_score * 0.45::DOUBLE + stability_score * 0.2::DOUBLE + growth_score * 0.2::DOUBLE + volatility_score * 0.15::DOUBLE AS strategic_importance_score FROM sc)"
)
_SCORES = ["scale_score", "stability_score", "volatility_score", "growth_score", "spike_score"]
_RS = ", ".join(f"round({c}, 6) AS {c}" for c in _SCORES)
classed = lambda t: S.archetype_indices(S.archetype(_r6(S.archetype_scores(t.sm), *_SCORES)))
_INDICES = list(S.INDEX_WEIGHTS)
add("archetype_scores", lambda t: _r6(S.archetype_scores(t.sm), *_SCORES), _SC + f" SELECT * REPLACE ({_RS}) FROM sc")
add("archetype", lambda t: classed(t).select("site_id", "archetype"), _SC + " SELECT site_id, archetype FROM ar")
add("archetype_indices", lambda t: _r6(classed(t), *_INDICES).select("site_id", *_INDICES), _SC + " SELECT site_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _INDICES) + " FROM ar")
_MEANS = [*_SCORES[:4], *_INDICES]
add(
    "archetype_summary",
    lambda t: _r6(S.archetype_summary(classed(t)), *[f"avg_{c}" for c in _MEANS]),
    _SC + " SELECT archetype, count(*) AS sites, sum(total_volume)::BIGINT AS total_volume, avg(total_volume) AS avg_total_volume, " + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in _MEANS) + ", sum(total_volume)::DOUBLE * 100 / sum(sum(total_volume)) OVER () AS traffic_share_pct FROM ar GROUP BY 1",
)
add(
    "diversified_top",
    lambda t: core.top(core.top_per_group(_r6(classed(t), "ooh_exposure_score"), "archetype", "ooh_exposure_score", "site_id", 3), 25, "ooh_exposure_score", "site_id").select("rank", "site_id", "archetype", "ooh_exposure_score"),
    _SC + ", e AS (SELECT site_id, archetype, round(ooh_exposure_score, 6) AS ooh_exposure_score FROM ar), d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY ooh_exposure_score DESC, site_id) <= 3) "
    "SELECT row_number() OVER (ORDER BY ooh_exposure_score DESC, site_id)::INTEGER AS rank, site_id, archetype, ooh_exposure_score FROM d QUALIFY rank <= 25",
)
_TIER = " SELECT *, traffic_share_pct / site_share_pct AS efficiency FROM (SELECT {n}, sites, total_volume, total_volume::DOUBLE * 100 / sum(total_volume) OVER () AS traffic_share_pct, sites::DOUBLE * 100 / sum(sites) OVER () AS site_share_pct FROM (SELECT {c} AS {n}, count(*) AS sites, sum(total_volume)::BIGINT AS total_volume FROM rk GROUP BY 1))"
add("strategy_tiers", lambda t: S.tiers(rk(t), S.STRATEGY_TIERS, S.LAST_TIER, "tier"), _TIER.format(n="tier", c="CASE WHEN rank <= 50 THEN 'Tier 1: Core' WHEN rank <= 100 THEN 'Tier 2: Strategic' WHEN rank <= 500 THEN 'Tier 3: Major' WHEN rank <= 1000 THEN 'Tier 4: Broad Network' ELSE 'Tier 5: Long Tail' END"))
add("rank_group_density", lambda t: S.tiers(rk(t), [(10, "Top 10"), (50, "11-50")], "Rest", "rank_group"), _TIER.format(n="rank_group", c="CASE WHEN rank <= 10 THEN 'Top 10' WHEN rank <= 50 THEN '11-50' ELSE 'Rest' END"))
_PF = ", n(portfolio_size) AS (VALUES (5), (10), (25), (50)), h AS (SELECT portfolio_size, sum(total_volume)::BIGINT AS captured_volume, count(*) AS sites, any_value(network_volume) AS nv, any_value(rk.sites) AS ns FROM n JOIN rk ON rank <= portfolio_size GROUP BY 1), pf AS (SELECT portfolio_size, captured_volume, sites, captured_volume::DOUBLE * 100 / nv AS captured_share_pct, sites::DOUBLE * 100 / ns AS site_share_pct, sites - coalesce(lag(sites) OVER w, 0) AS incremental_sites, captured_volume - coalesce(lag(captured_volume) OVER w, 0) AS incremental_volume, (captured_volume::DOUBLE * 100 / nv) / (sites::DOUBLE * 100 / ns) AS efficiency_ratio, nv - captured_volume AS remaining_volume FROM h WINDOW w AS (ORDER BY portfolio_size))"
add("portfolio_simulation", lambda t: S.portfolio_simulation(rk(t), [5, 10, 25, 50]), _PF + " SELECT * FROM pf")
add("concentration_at", lambda t: S.portfolio_simulation(rk(t), [5, 10, 25, 50]).select("portfolio_size", "captured_share_pct"), _PF + " SELECT portfolio_size, captured_share_pct FROM pf")
_RV = _PF + ", c(cpm) AS (VALUES (5::DOUBLE), (10)), u(utilisation) AS (VALUES (0.5::DOUBLE), (0.8)), rv AS (SELECT portfolio_size, sites, captured_volume, cpm, utilisation, captured_volume / 1e3 * cpm * utilisation AS revenue, sites * 12::DOUBLE AS cost FROM pf, c, u)"
scenarios = lambda t: S.revenue_scenarios(rk(t), [5, 10, 25, 50], [5, 10], [0.5, 0.8], 12)
add("revenue_scenarios", scenarios, _RV + " SELECT *, revenue - cost AS profit, (revenue - cost) * 100 / cost AS roi_pct, cost * 1000 / (captured_volume * utilisation) AS break_even_cpm FROM rv")
add(
    "tier_revenue",
    lambda t: S.tier_revenue(rk(t), 12),
    ", x AS (SELECT CASE WHEN rank <= 100 THEN 'Top 100' WHEN rank <= 500 THEN '101–500' WHEN rank <= 1000 THEN '501–1000' WHEN rank <= 2000 THEN '1001–2000' ELSE '2001+' END AS tier, count(*) AS sites, sum(total_volume)::BIGINT AS volume FROM rk GROUP BY 1), "
    "y AS (SELECT *, CASE tier WHEN 'Top 100' THEN 16 WHEN '101–500' THEN 12 WHEN '501–1000' THEN 8 WHEN '1001–2000' THEN 5 ELSE 3 END::DOUBLE AS cpm FROM x), z AS (SELECT *, volume / 1e3 * cpm AS revenue, sites * 12::DOUBLE AS cost FROM y) "
    "SELECT *, revenue - cost AS profit, (revenue - cost) * 100 / cost AS roi_pct FROM z",
)
add("roi_matrix", lambda t: scenarios(t).filter("portfolio_size = 50").groupBy("cpm").pivot("utilisation", [0.5, 0.8]).agg(F.max("roi_pct")).select("cpm", F.col("`0.5`").alias("use_50"), F.col("`0.8`").alias("use_80")), _RV + " SELECT cpm, max((revenue - cost) * 100 / cost) FILTER (utilisation = 0.5) AS use_50, max((revenue - cost) * 100 / cost) FILTER (utilisation = 0.8) AS use_80 FROM rv WHERE portfolio_size = 50 GROUP BY 1")
_BAND = ", b AS (SELECT site_id, total_volume, 100 * " + _PR.format("total_volume") + " AS volume_percentile, total_volume::DOUBLE / max(total_volume) OVER () AS ratio_to_max FROM st), bd AS (SELECT *, CASE WHEN volume_percentile >= 95 THEN 'red' WHEN volume_percentile >= 80 THEN 'orange' WHEN volume_percentile >= 50 THEN 'yellow' ELSE 'green' END AS volume_band, CASE WHEN ratio_to_max >= 0.85 THEN 'red' WHEN ratio_to_max >= 0.7 THEN 'orange' WHEN ratio_to_max >= 0.55 THEN 'amber' ELSE 'green' END AS heat FROM b)"
add("traffic_band", lambda t: S.traffic_band(t.site_totals), _BAND + " SELECT * FROM bd")
add(
    "exposure_metrics",
    lambda t: S.exposure_metrics(t.site_totals, 7),
    ", e AS (SELECT *, round_even(total_volume / 7::DOUBLE, 0)::BIGINT AS annual_volume, round_even(total_volume / (7 * 365.25)::DOUBLE, 0)::BIGINT AS daily_volume FROM st) SELECT *, round_even(daily_volume * 0.1::DOUBLE, 0)::BIGINT AS peak_hour_volume FROM e",
)
add(
    "exposure_text",
    lambda t: S.exposure_metrics(t.site_totals, 7).select("site_id", E.exposure_text(F.col("total_volume"), F.col("annual_volume"), F.col("daily_volume"), F.col("peak_hour_volume"), "seven years").alias("exposure_summary")),
    ", e AS (SELECT *, round_even(total_volume / 7::DOUBLE, 0)::BIGINT AS a, round_even(total_volume / (7 * 365.25)::DOUBLE, 0)::BIGINT AS d FROM st), x AS (SELECT *, round_even(d * 0.1::DOUBLE, 0)::BIGINT AS p FROM e) SELECT site_id, CASE WHEN total_volume <= 0 THEN 'Traffic total not matched; parcel enrichment is available but exposure metrics require a matching site total.' "
    "ELSE format('{:,}', total_volume) || ' vehicle movements across seven years; approximately ' || format('{:,}', a) || ' per year, ' || format('{:,}', d) || ' per day, and an indicative ' || format('{:,}', p) || ' vehicles in a major peak hour.' END AS exposure_summary FROM x",
)
add("opportunity_tier", lambda t: S.opportunity_tier(rk(t)), " SELECT site_id, total_volume, rank, CASE WHEN rank <= 10 THEN 'Elite Top 10' WHEN rank <= 25 THEN 'Premium Top 25' WHEN rank <= 50 THEN 'Strategic Top 50' ELSE 'High-Value Top 100' END AS tier FROM rk")
