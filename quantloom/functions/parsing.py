"""Text parsing functions of calendar and news feeds (SC03-SC08), as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^([+-]?[0-9]*\.?[0-9]+)([KMBT%]?)$"


def parse_value(text: Column) -> Column:
    """'0.3%', '-16.3K', '2.48T', '4.18|2.6' to a number; empty and non-numeric texts to NULL (SC04)."""
    first = F.upper(F.regexp_replace(F.element_at(F.split(F.trim(text), r"\|"), 1), r"[,\s]", ""))
    number, suffix = F.regexp_extract(first, NUMBER, 1), F.regexp_extract(first, NUMBER, 2)
    scale = F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9).when(suffix == "T", 1e12).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * scale)


def event_key(name: Column) -> Column:
    """'Core CPI m/m' to 'core_cpi_m_m' (SC03)."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


#: The part of a CSS class that tells the level.
IMPACTS = {"icon--ff-impact-red": "High", "icon--ff-impact-ora": "Medium", "icon--ff-impact-yel": "Low", "icon--ff-impact-gra": "Holiday"}


def impact_level(css: Column) -> Column:
    """The level that a CSS class holds, the first of IMPACTS that does; Unknown without one (SC05)."""
    return F.coalesce(*[F.when(css.contains(part), level) for part, level in IMPACTS.items()], F.lit("Unknown"))


def week_start(week: Column) -> Column:
    """'jul14.2025' to a date (SC07)."""
    return F.try_to_date(F.initcap(week), "MMMdd.yyyy")


def quarter_hour(ts: Column) -> Column:
    """Time floored to the quarter of an hour (SC08)."""
    return F.timestamp_micros(F.floor(F.unix_micros(ts.cast("timestamp")) / 900_000_000) * 900_000_000)


def tone_parts(tone: Column) -> list[Column]:
    """The six numbers of a comma-separated tone field; missing ones NULL (SRC07)."""
    return [F.get(F.split(tone, ","), F.lit(i)).try_cast("double") for i in range(6)]


def event_time(week: Column, days: int = 2) -> Column:
    """The usual day of a week's events: ``days`` after the Monday that 'jul14.2025' names (SC07)."""
    return F.date_add(week_start(week), days)


def clock_time(date_text: Column, time_text: Column, year: Column, zone: str = "America/New_York") -> Column:
    """'Mon Jan 13' and '6:30am' of a year to a UTC time (SC07). Texts without a time, 'Tentative' and 'All Day' are at
    noon; a date that can't be read is NULL."""
    bare = F.regexp_replace(F.trim(date_text), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+", "")
    day = F.try_to_date(F.concat_ws(" ", F.initcap(F.regexp_extract(bare, r"^([A-Za-z]{3})", 1)), F.lpad(F.regexp_extract(bare, r"^[A-Za-z]+\s*(\d+)", 1), 2, "0"), year.cast("string")), "MMM dd yyyy")
    clock = F.lower(F.trim(F.coalesce(time_text, F.lit(""))))
    known = clock.rlike(r"^\d{1,2}:\d{2}(am|pm)$")
    hour = F.regexp_extract(clock, r"^(\d{1,2}):", 1).try_cast("int") % 12 + F.when(clock.endswith("pm"), 12).otherwise(0)
    minutes = F.when(known, hour * 60 + F.regexp_extract(clock, r":(\d{2})", 1).try_cast("int")).otherwise(720)
    local = F.timestamp_micros((F.unix_date(day).cast("long") * 1440 + minutes) * 60_000_000)
    return F.to_utc_timestamp(local, zone)


def year_of(date_month: Column, today: Column) -> Column:
    """The year that a month without one means (SC07): last year's if it lies over half a year ahead of ``today``, next
    year's if over half a year behind."""
    ahead = date_month - F.month(today)
    return F.year(today) + F.when(ahead > 6, -1).when(ahead < -6, 1).otherwise(0)


def weeks(start: Column, end: Column) -> Column:
    """The Mondays from the week of ``start`` to ``end``, as 'jul14.2025' texts (SC08)."""
    first = F.date_sub(start, F.weekday(start))
    return F.transform(F.sequence(first, end, F.expr("interval 7 days")), lambda d: F.lower(F.date_format(d, "MMMdd.yyyy")))


def quarter_hours(start: Column, end: Column) -> Column:
    """The quarters of an hour from that of ``start`` to ``end`` (SC08)."""
    return F.sequence(quarter_hour(start), end.cast("timestamp"), F.expr("interval 15 minutes"))


def feature_words(name: Column) -> Column:
    """'volatility_100' to 'Volatility 100' (SC12)."""
    return F.initcap(F.regexp_replace(name, "_", " "))


def gene_sentence(left: Column, operator: Column, right: Column) -> Column:
    """A gene as a sentence: '<Left> is above <right>' (SC12)."""
    words = F.when(operator == ">", "is above").when(operator == "<", "is below").otherwise("equals")
    return F.concat_ws(" ", feature_words(left), words, right)


def strategy_tag(features: Column) -> Column:
    """The commonest first words of feature names, joined: a name for a strategy (SC12)."""
    roots = F.transform(features, lambda f: F.split(f, "_")[0])
    return F.array_join(F.slice(F.array_sort(F.array_distinct(roots)), 1, 3), "-")
