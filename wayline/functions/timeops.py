"""Clock arithmetic on columns: HH:MM texts, HHMM integers, minutes and seconds of the day.

Missing values are null inside; functions whose contract exposes -1 say so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero_filled(x: Column | str, width: int) -> Column:
    """Left zeros up to width; longer texts stay whole, which lpad would cut."""
    x = _c(x).cast("string")
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def hhmm(text: Column | str) -> Column:
    """'9:05' or '0905' as the integer 905; null where it is no number."""
    return F.replace(_c(text).cast("string"), F.lit(":"), F.lit("")).try_cast("int")


def minutes_of(value: Column) -> Column:
    """Minutes of an HHMM integer, without a wrap."""
    return F.floor(value / 100).cast("int") * 60 + F.pmod(value, F.lit(100))


def gap_minutes(start: Column | str, end: Column | str, days: Column | int | None = None) -> Column:
    """Minutes from one clock text to another; the end is on the next day if it is earlier, or `days` days
    on where that is given and not 0. -1 if a text is missing."""
    a, b = hhmm(start), hhmm(end)
    days = F.lit(0) if days is None else days if isinstance(days, Column) else F.lit(days)
    late = F.when(days != 0, days * 2400).when(b < a, 2400).otherwise(0)
    return F.coalesce(minutes_of(b + late) - minutes_of(a), F.lit(-1))


def gap(start: Column | str, end: Column | str, unit: str = "min", days: Column | int | None = None) -> Column:
    """gap_minutes as 'min', 'h' (a fraction) or 'h:m' (a text); null for other units."""
    m = gap_minutes(start, end, days)
    if unit == "min":
        return m
    if unit == "h":
        return F.when(m >= 0, m / 60).otherwise(m.cast("double"))
    if unit == "h:m":
        return F.when(m >= 0, F.concat(zero_filled(F.floor(m / 60), 2), F.lit(":"), zero_filled(F.pmod(m, F.lit(60)), 2))).otherwise("-1")
    return F.lit(None)


def signed_gap(start: Column | str, end: Column | str, day: Column | int) -> Column:
    """Minutes from start to end on the day `day` days after; it may be negative."""
    day = day if isinstance(day, Column) else F.lit(day)
    return (minutes_of(hhmm(end)) - minutes_of(hhmm(start)) + 1440 * day).cast("double")


def clock_number(text: Column | str, unit: str = "h") -> Column:
    """A clock text as hours or minutes; null if it is not made of digits."""
    digits = zero_filled(F.replace(_c(text), F.lit(":"), F.lit("")), 4)
    value = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))
    hours, rest = F.floor(value / 100), F.pmod(value, F.lit(100))
    return hours + rest / 60 if unit == "h" else (hours * 60 + rest).cast("double")


def clock_text(x: Column | str, unit: str = "h") -> Column:
    """Hours as HH:MM with minutes rounded half to even, so that ':60' can occur; minutes behind '00:' without a carry."""
    x = _c(x)
    if unit == "m":
        return F.concat(F.lit("00:"), zero_filled(x.cast("int"), 2))
    whole = x.cast("int")
    return F.concat(zero_filled(whole, 2), F.lit(":"), zero_filled(F.rint((x - whole) * 60).cast("int"), 2))


def clock_text_carried(x: Column | str) -> Column:
    """Hours as HH:MM, with a carry into the hour."""
    m = F.rint(_c(x) * 60).cast("int")
    return F.concat(zero_filled(F.floor(m / 60).cast("int"), 2), F.lit(":"), zero_filled(F.pmod(m, F.lit(60)), 2))


def to_minutes(value: Column | str) -> Column:
    """Minutes of HHMM; one day is added to a negative value."""
    v = _c(value)
    return minutes_of(F.when(v < 0, v + 2400).otherwise(v))


def to_hhmm(minutes: Column | str) -> Column:
    """HHMM of minutes; one day is taken from values of 2400 and more."""
    m = _c(minutes)
    v = F.floor(m / 60).cast("int") * 100 + F.pmod(m, F.lit(60))
    return F.when(v >= 2400, v - 2400).otherwise(v)


def to_utc(value: Column | str, zone: Column | str) -> Column:
    """HHMM at a whole-hour offset as UTC; -1 stays; a negative result gets a day, a large one keeps it."""
    v = _c(value)
    moved = v - 100 * _c(zone)
    return F.when(v == -1, -1).when(moved < 0, moved + 2400).otherwise(moved)


def to_local(value: Column | str, zone: Column | str) -> Column:
    """UTC HHMM at a whole-hour offset; -1 stays; results above 2400 lose a day, 2400 itself stays."""
    v = _c(value)
    moved = v + 100 * _c(zone)
    return F.when(v == -1, -1).when(moved > 2400, moved - 2400).otherwise(moved)


def wrapped_clock(minutes: Column | str) -> Column:
    """Minutes from any midnight as HH:MM of a day."""
    m = F.pmod(_c(minutes), F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))


def hhmm_clock(value: Column | str) -> Column:
    """HHMM as hh:mm, '--' where it is missing or -1."""
    v = _c(value)
    text = zero_filled(v, 4)
    return F.when(v.isNull() | (v < 0), "--").otherwise(F.concat(F.left(text, F.length(text) - 2), F.lit(":"), F.right(text, F.lit(2))))


def ride(depart: Column | str, arrive: Column | str, day: int = 86_400) -> Column:
    """Time from departure to arrival; no time at all counts as a whole day."""
    d = _c(arrive) - _c(depart)
    return F.when(d > 0, d).otherwise(d + day)


def of_day(seconds: Column | str, day: int = 86_400) -> Column:
    return F.pmod(_c(seconds), F.lit(day))


def iso_clock(text: Column | str) -> Column:
    """HH:MM of a time stamp text that ends in HH:MM:SS."""
    return F.substring(_c(text), -8, 5)


def is_clock(text: Column | str) -> Column:
    """Has the text digits only, apart from '-' and ':', and one at least?"""
    return F.coalesce(F.regexp_replace(_c(text), "[-:]", "").rlike("^[0-9]+$"), F.lit(False))
