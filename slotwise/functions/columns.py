"""Column expressions shared by the operators; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def slot_to_time_bin(slot: Column) -> Column:
    """Slot 0..95 to 'HH:MM'; null outside."""
    return F.when(slot.between(0, 95), F.format_string("%02d:%02d", (slot / 4).cast("int"), (slot % 4 * 15).cast("int")))


def trim_time_bin(text: Column) -> Column:
    """'HH:MM:SS' to 'HH:MM'; shorter text as it is."""
    return F.when(F.length(text) >= 5, F.substring(text, 1, 5)).otherwise(text)


def time_bin_to_minutes(text: Column) -> Column:
    """Minutes of 'HH:MM' or 'HH:MM:SS'; a plain number under 96 is a slot; null for anything else."""
    hour = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})", 1).try_cast("int")
    minute = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})", 2).try_cast("int")
    slot = F.trim(text).try_cast("int")
    return F.coalesce(hour * 60 + minute, F.when(slot.between(0, 95), slot * 15))


def timestamp_to_slot(ts: Column) -> Column:
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)).cast("int")


def clean_site_id(text: Column) -> Column:
    """The first run of digits, as a number ('4415.0', 'Site 4415'); null without one."""
    return F.regexp_extract(text, r"\d+", 0).try_cast("bigint")


# Words that stand for a missing name, and the most characters of a label.
NO_NAMES = ["nan", "none", "null", "na", "n/a"]
LABEL_LENGTH = 58

# What road words are written as. The first list holds in any name, in this order; the second in names all in capitals, after they are put in title case.
ROAD_WORDS = [(" NR ", " near "), (" BTW ", " between "), (" FWY ", " Freeway "), (" HWY", " Highway"), ("PHE", "Princes Highway East"), ("/", " / ")]
TITLE_WORDS = [("Fwy", "Freeway"), ("Hwy", "Highway"), ("Mrr", "MRR"), ("Phe", "Princes Highway East"), ("Nr", "near"), ("Btw", "between"), ("Cbd", "CBD"), ("Rd", "Road"), ("St", "Street"), ("Ave", "Avenue")]


def clean_label(text: Column, most: int = LABEL_LENGTH) -> Column:
    """'' for null, blank, date-like and number-only names and words for nothing; underscores and runs of spaces become one space; longer text is cut and ends in an ellipsis."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    odd = bare.rlike(r"^\d{4}-\d{2}(-\d{2})?$") | bare.rlike(r"^\d+(\.0)?$") | F.lower(bare).isin(NO_NAMES)
    flat = F.trim(F.regexp_replace(bare, r"[_\s]+", " "))
    return F.when(odd, "").when(F.length(flat) > most, F.concat(F.rtrim(F.left(flat, F.lit(most - 1))), F.lit("…"))).otherwise(flat)


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first, whatever stands between (initcap knows spaces only)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def friendly_name(name: Column, site: Column) -> Column:
    """A road name with its words written out; 'SCATS Site <id>' for an empty name. Only names all in capitals are put in title case."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    spaced = reduce(lambda c, w: F.replace(c, F.lit(w[0]), F.lit(w[1])), ROAD_WORDS, bare)
    spaced = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    titled = reduce(lambda c, w: F.replace(c, F.lit(w[0]), F.lit(w[1])), TITLE_WORDS, title_case(spaced))
    empty = (bare == "") | (F.lower(bare) == "nan")
    return F.when(empty, F.concat(F.lit("SCATS Site "), site.cast("string"))).when(F.upper(spaced) == spaced, titled).otherwise(spaced)


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column, b: Column) -> Column:
    return safe_div(a.cast("double") * 100, b)


def pct_rank(value: Column, *partition: Column) -> Column:
    """Average rank of ties over the number of values; null for null."""
    ordered = Window.partitionBy(*partition).orderBy(value.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.when(value.isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / F.count(value).over(Window.partitionBy(*partition)))


def rolling(value: Column, over: WindowSpec, n: int, least: int, how: object = F.avg) -> Column:
    """``how`` over this and the n - 1 rows before; null with fewer than ``least`` values."""
    frame = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= least, how(value).over(frame))


def day_name(iso_dow: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), iso_dow)


def iso_dow(date: Column | str) -> Column:
    return F.weekday(date) + 1


def month_label(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM")


def first_match(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def percentile_band(rank: Column, n: Column) -> Column:
    share = rank / n
    return first_match((share <= 0.01, "Top 1%"), (share <= 0.05, "Top 5%"), (share <= 0.10, "Top 10%"), (share <= 0.25, "Top 25%"), (share <= 0.50, "Top 50%"), otherwise="Bottom 50%")


def season(month: Column) -> Column:
    """Southern hemisphere."""
    return first_match((month.isin(12, 1, 2), "summer"), (month.isin(3, 4, 5), "autumn"), (month.isin(6, 7, 8), "winter"), (month.isin(9, 10, 11), "spring"))
