"""Queries: map-ready tables and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import columns as C
from slotwise.operators import core
from slotwise.operators import exports as E
from slotwise.operators import sites as S
from slotwise.operators import trends as T
from slotwise.plans.base import add
from slotwise.plans.growth import _BAND
from slotwise.plans.profiles import _r6
from slotwise.plans.trends import _PER, rows

DAYS = ["2024-01-03", "2024-01-04"]
pulse = lambda t: E.pulse(t.obs_days, DAYS)
full = lambda t: E.enrich_pulse(pulse(t), t.sites)
_P = ", pl AS (SELECT site_id, count_date, time_bin, sum(volume_15m)::BIGINT AS volume FROM obs_days WHERE count_date IN (DATE '2024-01-03', DATE '2024-01-04') GROUP BY 1, 2, 3)"


def _scaled(table, by=""):  # noqa: ANN001, ANN202
    """SQL of ``exports.scaled`` over a table, or by a column of it."""
    over, group = (f" WHERE q.{by} = {table}.{by}", f"{by}, ") if by else ("", "")
    cuts = "max(volume) AS top, " + ", ".join(f"quantile_cont(volume, {q})::DOUBLE AS {n}" for q, n in ((0.98, "qd"), (0.9, "qc"), (0.75, "qb"), (0.5, "qa")))
    return (
        f"SELECT {table}.*, ln(1 + volume) AS scaled_volume, CASE WHEN top > 0 THEN ln(1 + volume) / ln(1 + top) * 100 ELSE 0 END AS scaled_volume_0_100, "
        f"CASE WHEN volume >= qd THEN 'extreme' WHEN volume >= qc THEN 'very high' WHEN volume >= qb THEN 'high' WHEN volume >= qa THEN 'medium' ELSE 'low' END AS intensity_band FROM {table}, (SELECT {group}{cuts} FROM {table}{' GROUP BY 1' if by else ''}) q{over}"
    )


_STAMP = "strptime(count_date::VARCHAR || ' ' || time_bin, '%Y-%m-%d %H:%M') AS timestamp, time_bin[1:2]::INTEGER AS hour, time_bin[4:5]::INTEGER AS minute, time_bin AS time_label, count_date::VARCHAR AS date_label, dayname(count_date) AS day_name"
_E = _P + f", placed AS (SELECT site_id, site_name, latitude, longitude, count_date, time_bin, volume, {_STAMP} FROM pl JOIN sites USING (site_id) WHERE latitude IS NOT NULL AND volume >= 1), en AS ({_scaled('placed')})"
_SHOWN = "* REPLACE (round(scaled_volume, 9) AS scaled_volume, round(scaled_volume_0_100, 6) AS scaled_volume_0_100, {0})"
rounded = lambda df, *stamps: df.withColumns({"scaled_volume": F.round("scaled_volume", 9), "scaled_volume_0_100": F.round("scaled_volume_0_100", 6)} | {c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in stamps})
_MINUTE = "strftime({0}, '%Y-%m-%d %H:%M') AS {0}"
add("pulse", pulse, _P + " SELECT * FROM pl")
add("enrich_pulse", lambda t: rounded(full(t), "timestamp"), _E + f" SELECT {_SHOWN.format(_MINUTE.format('timestamp'))} FROM en")
add("intensity_band", lambda t: full(t).select("site_id", "count_date", "time_bin", "volume", "intensity_band"), _E + " SELECT site_id, count_date, time_bin, volume, intensity_band FROM en")
add(
    "pulse_all_stores",
    lambda t: E.pulse(core.clean(t.raw_days, "filter").withColumn("time_bin", C.slot_to_time_bin(F.col("interval_index"))), DAYS),
    " SELECT site_id, count_date, printf('%02d:%02d', interval_index // 4, interval_index % 4 * 15) AS time_bin, sum(volume_15m)::BIGINT AS volume FROM raw_days WHERE volume_15m >= 0 AND count_date IN (DATE '2024-01-03', DATE '2024-01-04') GROUP BY 1, 2, 3",
)
add(
    "am_pm_pulse",
    lambda t: E.am_pm(full(t)).select("site_id", "count_date", "time_bin", "volume", "peak_period", "comparison_longitude", "comparison_latitude"),
    _E + " SELECT site_id, count_date, time_bin, volume, CASE WHEN time_bin < '12:00' THEN 'AM Peak 07:00-10:00' ELSE 'PM Peak 16:00-19:00' END AS peak_period, longitude + CASE WHEN time_bin < '12:00' THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS comparison_longitude, latitude AS comparison_latitude FROM en "
    "WHERE (time_bin >= '07:00' AND time_bin < '10:00') OR (time_bin >= '16:00' AND time_bin < '19:00')",
)
add("overnight_pulse", lambda t: E.overnight(pulse(t)), _P + " SELECT * FROM pl WHERE time_bin < '05:00'")
_CP = (
    _PER + ", cp AS (SELECT period, CASE period WHEN 'baseline' THEN 0 WHEN 'shock' THEN 1 ELSE 2 END AS sequence, site_id, count_date, time_bin, sum(volume_15m)::BIGINT AS volume FROM pr GROUP BY ALL), "
    f"cq AS (SELECT cp.*, site_name, latitude, longitude, {_STAMP} FROM cp JOIN sites USING (site_id) WHERE latitude IS NOT NULL AND volume >= 1), ce AS ({_scaled('cq', 'sequence')})"
)
add(
    "comparison_pulse",
    lambda t: rounded(E.comparison_pulse(rows(t), t.sites), "timestamp", "animation_timestamp"),
    _CP + ", o AS (SELECT TIMESTAMP '2030-01-01' + to_days(sequence) + to_hours(hour) + to_minutes(minute) AS animation_timestamp, timestamp, date_label, sequence AS comparison_sequence, period AS comparison_period, time_label, hour, minute, site_id, site_name, latitude, longitude, volume, scaled_volume, scaled_volume_0_100, intensity_band FROM ce) "
    f"SELECT {_SHOWN.format(_MINUTE.format('timestamp') + ', ' + _MINUTE.format('animation_timestamp'))} FROM o",
)
_SP = (
    ", so AS (SELECT site_id, sum(month_site_volume)::BIGINT AS site_total_volume, row_number() OVER (ORDER BY sum(month_site_volume) DESC, site_id)::INTEGER AS site_rank FROM sm WHERE month_site_volume >= 1 GROUP BY 1 QUALIFY site_rank <= 100), "
    "sd AS (SELECT (month_label || '-01')::DATE AS animation_timestamp, (month_label || '-01')::DATE AS month_start, month_label, month_label[1:4]::INTEGER AS year, month_label[6:7]::INTEGER AS month_of_year, monthname((month_label || '-01')::DATE) AS month_name, "
    "CASE WHEN month_label[6:7] IN ('12', '01', '02') THEN 'summer' WHEN month_label[6:7] <= '05' THEN 'autumn' WHEN month_label[6:7] <= '08' THEN 'winter' ELSE 'spring' END AS seasonal_band, site_rank, site_id, site_name, latitude, longitude, month_site_volume AS volume, site_total_volume "
    "FROM sm JOIN so USING (site_id) JOIN sites USING (site_id) WHERE month_site_volume >= 1 AND latitude BETWEEN -39.5 AND -36 AND longitude BETWEEN 143 AND 146.5), "
    f"se AS ({_scaled('sd')})"
)
add("seasonal_pulse", lambda t: rounded(E.seasonal_pulse(t.sm, t.sites)), _SP + f" SELECT {_SHOWN.format('volume AS volume')} FROM se")
add("valid_coordinates", lambda t: S.valid_coordinates(t.sites, (-37.9, -37.7, 144.9, 145.1)).select("site_id"), "SELECT site_id FROM sites WHERE latitude BETWEEN -37.9::DOUBLE AND -37.7::DOUBLE AND longitude BETWEEN 144.9::DOUBLE AND 145.1::DOUBLE")
# Names as they come: all capitals, mixed, number and no names.
_NAMES = {0: "SMITH ST/JONES AVE NR STATION RD", 1: "Eastern FWY NR Toorak Rd", 2: "", 3: "PHE BTW 1ST AVE", 5: "O'BRIEN CRES -  NEPEAN HWY", 6: "cbd loop HWY/Mrr"}
named = lambda t: t.sites.withColumn("site_name", C.first_match(*[(F.col("site_id") % 7 == i, F.lit(n)) for i, n in _NAMES.items()], otherwise=F.col("site_name")))
_N = ", nm AS (SELECT * REPLACE (CASE site_id % 7 " + " ".join("WHEN {} THEN '{}'".format(i, n.replace("'", "''")) for i, n in _NAMES.items()) + " ELSE site_name END AS site_name) FROM sites)"


def _replaced(text, words):  # noqa: ANN001, ANN202
    for old, new in words:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_SPACED = "trim(regexp_replace(" + _replaced("trim(coalesce(site_name, ''))", [(" NR ", " near "), (" BTW ", " between "), (" FWY ", " Freeway "), (" HWY", " Highway"), ("PHE", "Princes Highway East"), ("/", " / ")]) + ", '\\s+', ' ', 'g'))"
_TITLED = _replaced("array_to_string(list_transform(regexp_extract_all(lower(sp), '([a-z]+|[^a-z]+)'), lambda p: upper(p[1:1]) || p[2:]), '')", [("Fwy", "Freeway"), ("Hwy", "Highway"), ("Mrr", "MRR"), ("Phe", "Princes Highway East"), ("Nr", "near"), ("Btw", "between"), ("Cbd", "CBD"), ("Rd", "Road"), ("St", "Street"), ("Ave", "Avenue")])
_N += f", ns AS (SELECT *, {_SPACED} AS sp FROM nm), nf AS (SELECT *, CASE WHEN trim(coalesce(site_name, '')) = '' THEN 'SCATS Site ' || site_id WHEN upper(sp) = sp THEN {_TITLED} ELSE sp END AS friendly_name FROM ns)"
_MAP = _BAND + _N + (
    ", mp AS (SELECT row_number() OVER (ORDER BY total_volume DESC, site_id)::INTEGER AS rank, site_id, friendly_name, coalesce(site_name, '') AS site_name, municipality, total_volume AS total_cleaned_volume, latitude, longitude, latitude IS NOT NULL AND longitude IS NOT NULL AS has_coordinates, "
    "volume_percentile AS percentile_rank, volume_band AS traffic_band, round(ratio_to_max, 6) AS volume_ratio, 'https://www.google.com/maps/search/?api=1&query=' || CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN latitude::VARCHAR || ',' || longitude::VARCHAR "
    "ELSE replace('SCATS ' || site_id || ' ' || friendly_name || ' Victoria', ' ', '%20') END AS google_maps_url FROM bd LEFT JOIN nf USING (site_id))"
)
add("site_map", lambda t: E.site_map(t.site_totals, named(t)), _MAP + " SELECT * FROM mp")
add("unmatched_sites", lambda t: E.site_map(t.site_totals, named(t)).filter("not has_coordinates").select("site_id", "total_cleaned_volume"), _MAP + " SELECT site_id, total_cleaned_volume FROM mp WHERE NOT has_coordinates")
add("map_links", lambda t: t.sites.filter("latitude is not null").select("site_id", E.map_link(F.col("latitude"), F.col("longitude")).alias("map_link")), "SELECT site_id, printf('https://www.google.com/maps?q=%.6f,%.6f', latitude, longitude) AS map_link FROM sites WHERE latitude IS NOT NULL")
add("ranked_locations", lambda t: core.top(t.site_totals.join(S.valid_coordinates(named(t)), "site_id").select("site_id", "total_volume", C.friendly_name(F.col("site_name"), F.col("site_id")).alias("display_name")), 20, "total_volume", "site_id"), _N + ", v AS (SELECT st.*, friendly_name AS display_name FROM st JOIN nf USING (site_id) WHERE latitude IS NOT NULL) SELECT *, row_number() OVER (ORDER BY total_volume DESC, site_id)::INTEGER AS rank FROM v QUALIFY rank <= 20")
add("coordinates_on_variability", lambda t: _r6(S.site_features(t.sm), "cv").select("site_id", "cv").join(t.sites.select("site_id", "latitude", "longitude"), "site_id", "left"), "SELECT site_id, round(stddev_samp(month_site_volume) / avg(month_site_volume), 6) AS cv, any_value(latitude) AS latitude, any_value(longitude) AS longitude FROM sm LEFT JOIN sites USING (site_id) GROUP BY 1")
add("calendar_functions", lambda t: t.daily.select("count_date", F.year("count_date").alias("y"), F.month("count_date").alias("m"), C.iso_dow(F.col("count_date")).alias("d"), F.weekofyear("count_date").alias("w"), F.extract(F.lit("yearofweek"), "count_date").alias("iy"), F.dayofyear("count_date").alias("doy"), F.trunc("count_date", "month").alias("month_start"), F.last_day("count_date").alias("month_end"), C.month_label(F.col("count_date")).alias("label")), "SELECT count_date, year(count_date)::INTEGER AS y, month(count_date)::INTEGER AS m, isodow(count_date)::INTEGER AS d, week(count_date)::INTEGER AS w, isoyear(count_date)::INTEGER AS iy, dayofyear(count_date)::INTEGER AS doy, date_trunc('month', count_date)::DATE AS month_start, last_day(count_date) AS month_end, strftime(count_date, '%Y-%m') AS label FROM daily")
# Names for nothing, and what is left of them; a name of over 58 characters.
_LABELS = [" 2024-01 ", "4415.0", "N/A", "Main_St  corner", "x" * 50 + " 123456 and more", "2024-01-05"]
_CLEAN = ["", "", "", "Main St corner", "x" * 50 + " 123456…", ""]
add("text_functions", lambda t: t.sites.select("site_id", C.clean_site_id(F.concat(F.lit("Site "), F.col("site_id").cast("string"), F.lit(".0"))).alias("parsed"), C.clean_label(C.first_match(*[(F.col("site_id") % 9 == i, F.lit(n)) for i, n in enumerate(_LABELS)], otherwise=F.concat(F.lit("  "), "municipality", F.lit("   x ")))).alias("label"), C.trim_time_bin(F.lit("07:15:00")).alias("trimmed"), C.time_bin_to_minutes(F.lit("07:15:00")).alias("minutes"), C.time_bin_to_minutes((F.col("site_id") * 5).cast("string")).alias("slot_minutes"), F.format_number(F.col("site_id") * 1000, 0).alias("shown")), "SELECT site_id, site_id::BIGINT AS parsed, CASE site_id % 9 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_CLEAN)) + " ELSE replace(municipality, '_', ' ') || ' x' END AS label, '07:15' AS trimmed, 435 AS minutes, CASE WHEN site_id * 5 < 96 THEN site_id * 75 END AS slot_minutes, format('{:,}', site_id * 1000) AS shown FROM sites")
