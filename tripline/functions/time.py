"""Time expressions and opening hours. Timestamps are naive; elapsed time is in whole seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
HOURS_TYPE = "map<string,array<double>>"
RANGE = r"(?i)(\d{1,2})(?::(\d{2}))?\s*(AM|PM)\s*[–-]\s*(\d{1,2})(?::(\d{2}))?\s*(AM|PM)"


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def hours_between(a: Column, b: Column) -> Column:
    return seconds_between(a, b) / 3600.0


def days_between(a: Column, b: Column) -> Column:
    """Whole days that have passed, not calendar days."""
    return F.floor(seconds_between(a, b) / 86400)


def from_epoch_ms(ms: Column) -> Column:
    """A naive timestamp in UTC, cut to seconds."""
    return F.timestamp_add("SECOND", F.floor(ms / 1000), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def iso_weekday(ts: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(ts) + 1


def is_weekend(ts: Column, legacy: bool = False) -> Column:
    """Saturday and Sunday; legacy counts Friday too, as the source of these features does."""
    return iso_weekday(ts) >= (5 if legacy else 6)


def within_hours(ts: Column, start: int, end: int) -> Column:
    return (F.hour(ts) >= start) & (F.hour(ts) < end)


def meal_flags(ts: Column) -> dict[str, Column]:
    return {"breakfast": within_hours(ts, 6, 10), "lunch": within_hours(ts, 11, 14), "dinner": within_hours(ts, 17, 21)}


def meal_type(ts: Column) -> Column:
    out = None
    for name, flag in meal_flags(ts).items():
        out = F.when(flag, name) if out is None else out.when(flag, name)
    return out.otherwise("other")


def delta_bucket(hours: Column) -> Column:
    return (
        F.when(hours < 3, "0-3h").when(hours < 6, "3-6h").when(hours < 12, "6-12h").when(hours < 24, "12-24h")
        .when(hours < 72, "1-3d").when(hours >= 72, "3-7d")
    )


def add_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(hours * 3_600_000_000).cast("bigint"), ts)


def parse_or(c: Column, fallback: str = "2020-01-01 00:00:00") -> Column:
    """A naive timestamp from ISO text, or the fallback."""
    return F.coalesce(F.try_to_timestamp(c).cast("timestamp_ntz"), F.lit(fallback).cast("timestamp_ntz"))


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    h = hour.try_cast("int") % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0)
    return h + F.coalesce(minute.try_cast("int"), F.lit(0)) / 60.0


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body for the value, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_hours(hours: Column) -> Column:
    """Opening hours [[day, range], ...] as a struct: parsed (day -> [open, close] or null), days_open, avg_hours, late_night,
    open_24h, weekend_only. parsed and the numbers are null, and the flags false, if nothing can be read.

    A closed day is null and not counted; close below open is past midnight (+24); a repeated day is counted twice, and its last
    range stands. The 24-hour case does not make late_night.
    """
    given = F.filter(
        F.coalesce(hours, F.array().cast("array<array<string>>")), lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()
    )

    def entry(p: Column) -> Column:
        text, low = p[1], F.lower(p[1])
        group = [F.regexp_extract(text, RANGE, i) for i in range(1, 7)]
        opens, closes = _clock(group[0], F.nullif(group[1], F.lit("")), group[2]), _clock(group[3], F.nullif(group[4], F.lit("")), group[5])
        clocks = F.struct(opens.alias("opens"), closes.alias("closes"))
        span = _once(clocks, lambda c: F.array(c["opens"], F.when(c["closes"] < c["opens"], c["closes"] + 24).otherwise(c["closes"])))
        shut = F.contains(low, F.lit("closed"))
        whole = ~shut & F.contains(low, F.lit("24")) & F.contains(low, F.lit("hour"))
        ranged = F.when(text.rlike(RANGE), span)
        span = F.when(shut, F.lit(None).cast("array<double>")).when(whole, F.array(F.lit(0.0), F.lit(24.0))).otherwise(ranged)
        return F.struct(F.lower(F.trim(p[0])).alias("day"), span.alias("span"), shut.alias("shut"), whole.alias("whole"))

    entries = F.filter(F.transform(given, entry), lambda e: e["shut"] | e["span"].isNotNull())
    return _once(entries, _opening)


def _opening(entries: Column) -> Column:
    """What parse_hours tells of the entries that can be read."""
    spans = F.transform(F.filter(entries, lambda e: e["span"].isNotNull()), lambda e: e["span"])
    total = F.aggregate(spans, F.lit(0.0), lambda s, x: s + (x[1] - x[0]))
    some = F.size(entries) > 0
    names = F.array_distinct(F.transform(entries, lambda e: e["day"]))
    last = F.transform(names, lambda d: F.struct(d.alias("key"), F.element_at(F.filter(entries, lambda e: e["day"] == d), -1)["span"].alias("value")))
    count = F.size(spans)
    return F.struct(
        F.when(some, F.map_from_entries(last)).alias("parsed"),
        F.when(some, count).alias("days_open"),
        F.when(some, F.round(total / F.greatest(count, F.lit(1)), 2)).alias("avg_hours"),
        F.exists(entries, lambda e: F.coalesce(~e["whole"] & (e["span"][1] >= 23), F.lit(False))).alias("late_night"),
        F.exists(entries, lambda e: e["whole"]).alias("open_24h"),
        (some & (count <= 2) & F.exists(names, lambda d: d.isin("saturday", "sunday"))).alias("weekend_only"),
    )


def open_at(parsed: Column, day: Column, hour: Column) -> Column:
    """Whether a place is open on the day (a name) at the hour; true without data or without an entry for the day."""
    span = F.try_element_at(parsed, day)
    here = F.coalesce(F.array_contains(F.map_keys(parsed), day), F.lit(False))
    inside = F.when(span[1] > 24, (hour >= span[0]) | (hour <= span[1] - 24)).otherwise((hour >= span[0]) & (hour <= span[1]))
    return F.when(parsed.isNull() | ~here, True).when(span.isNull(), False).otherwise(inside)


def weekday_name(ts: Column, legacy: bool = False) -> Column:
    """The day's name; legacy gives that of the next day, as the source of these features does."""
    at = (F.weekday(ts) + (1 if legacy else 0)) % 7
    return F.element_at(F.array(*[F.lit(d) for d in DAYS]), at + 1)


def hours_overlap(a: Column, b: Column) -> Column:
    """Whether two places are open together on some day; true without data or without a common day."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    both = F.exists(
        common,
        lambda d: F.coalesce(
            F.greatest(F.try_element_at(a, d)[0], F.try_element_at(b, d)[0]) < F.least(F.try_element_at(a, d)[1], F.try_element_at(b, d)[1]),
            F.lit(False),
        ) & F.try_element_at(a, d).isNotNull() & F.try_element_at(b, d).isNotNull(),
    )
    return F.when(a.isNull() | b.isNull() | (F.size(common) == 0), True).otherwise(both)


def opens_early(parsed: Column, until: float = 9) -> Column:
    return F.coalesce(F.exists(F.map_values(parsed), lambda x: F.coalesce(x[0] <= until, F.lit(False))), F.lit(False))


def closes_late(parsed: Column) -> Column:
    return F.coalesce(F.exists(F.map_values(parsed), lambda x: F.coalesce((x[1] >= 23) | (x[1] <= 3), F.lit(False))), F.lit(False))
