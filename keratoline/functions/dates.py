"""Dates, times and sides as the sources write them. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)^\s+|\s+\z"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends (trim() knows spaces only)."""
    return F.regexp_replace(c, BLANKS, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def _ymd(c: Column, pattern: str, y: int, m: int, d: int) -> Column:
    return F.concat(F.lpad(_number(c, pattern, y), 4, "0"), F.lpad(_number(c, pattern, m), 2, "0"), F.lpad(_number(c, pattern, d), 2, "0"))


def _number(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(_part(c, pattern, group), F.lit("")).try_cast("bigint").cast("string")


ISO = r"^([0-9]{4})-([0-9]{1,4})-([0-9]{1,4})\z"
SLASHED = r"^([0-9]+)/([0-9]+)/([0-9]+)\z"
DOTTED = r"^([0-9]+)\.([0-9]+)\.([0-9]+)\z"


def manifest_date(c: Column) -> Column:
    """YYYY-MM-DD and M/D/YYYY (year above 1900) become YYYYMMDD; anything else is kept, trimmed. No calendar check."""
    s = trimmed(c)
    iso = s.rlike(ISO) & (F.length(s) == 10)
    slash = s.rlike(SLASHED) & (F.coalesce(_part(s, SLASHED, 3).try_cast("bigint"), F.lit(0)) > 1900)
    return F.when(iso, _ymd(s, ISO, 1, 2, 3)).when(slash, _ymd(s, SLASHED, 3, 1, 2)).otherwise(s)


def manifest_time(c: Column) -> Column:
    """Six digits stay; else colons and dots go."""
    s = trimmed(c)
    return F.when(s.rlike(r"^[0-9]{6}\z"), s).otherwise(F.regexp_replace(s, "[:.]", ""))


def header_date(c: Column) -> Column:
    """Dates printed on pages: M.D.Y or M/D/Y if the third part is a year, Y.M.D if the first is, ISO; else kept, trimmed."""
    s = trimmed(c)
    out = F.when(s.rlike(ISO) & (F.length(s) == 10), _ymd(s, ISO, 1, 2, 3)).otherwise(s)
    for pattern, there in ((SLASHED, ~F.contains(s, F.lit("."))), (DOTTED, F.lit(True))):
        year = lambda g, p=pattern: F.coalesce(F.nullif(_part(s, p, g), F.lit("")).try_cast("bigint"), F.lit(0)) > 1900
        fits = s.rlike(pattern) & there
        out = F.when(fits & year(3), _ymd(s, pattern, 3, 1, 2)).when(fits & year(1), _ymd(s, pattern, 1, 2, 3)).otherwise(out)
    return out


def header_time(c: Column) -> Column:
    return F.regexp_replace(c, "[:.]", "")


def _piece(c: Column, at: int, size: int, default: int) -> Column:
    whole = F.substring(c, at, size)
    return F.when((F.octet_length(c) >= at + size - 1) & whole.rlike(r"^\+?[0-9]+\z"), whole.try_cast("int")).otherwise(F.lit(default))


def approximate_epoch(date: Column, time: Column) -> Column:
    """Seconds in a calendar of 365-day years and 30-day months, as visit keys take them.

    Parts that don't parse default to year 2000, month and day 1, and 0 hours,
    minutes and seconds, each by itself. A date of fewer than 8 bytes gives 0.
    """
    days = (_piece(date, 1, 4, 2000) - 1970) * 365 + (_piece(date, 5, 2, 1) - 1) * 30 + _piece(date, 7, 2, 1)
    clock = _piece(time, 1, 2, 0) * 3600 + _piece(time, 3, 2, 0) * 60 + _piece(time, 5, 2, 0)
    return F.when(F.octet_length(date) >= 8, days.cast("bigint") * 86400 + F.coalesce(clock, F.lit(0))).otherwise(F.lit(0).cast("bigint"))


def calendar_epoch(date: Column, time: Column) -> Column:
    """Seconds since 1970 in UTC by the true calendar; null if the date has under 8 bytes or is no date."""
    stamp = F.try_make_timestamp(
        years=_piece(date, 1, 4, 2000), months=_piece(date, 5, 2, 1), days=_piece(date, 7, 2, 1),
        hours=_piece(time, 1, 2, 0), mins=_piece(time, 3, 2, 0), secs=_piece(time, 5, 2, 0).cast("decimal(8,6)"), timezone=F.lit("UTC"),
    )
    return F.when(F.octet_length(date) >= 8, F.unix_seconds(stamp))


def test_time(date: Column, time: Column) -> Column:
    """YYMMDDHHMMSS; a time of fewer than 6 bytes counts as 000000; empty if the date has under 8 bytes."""
    clock = F.when(F.octet_length(time) >= 6, F.substring(time, 1, 6)).otherwise(F.lit("000000"))
    return F.when(F.octet_length(date) >= 8, F.concat(F.substring(date, 3, 6), clock)).otherwise(F.lit(""))


def laterality(c: Column) -> Column:
    """R and OD become OD, L and OS become OS, anything else null."""
    s = F.upper(trimmed(c))
    return F.when(s.isin("R", "OD"), F.lit("OD")).when(s.isin("L", "OS"), F.lit("OS"))


def eye_phrase(c: Column) -> Column:
    """The side that a printed phrase names."""
    s = F.upper(c)
    return F.when(F.contains(s, F.lit("RIGHT")) | s.isin("OD", "R"), F.lit("OD")).when(F.contains(s, F.lit("LEFT")) | s.isin("OS", "L"), F.lit("OS"))


def right_eye(c: Column) -> Column:
    """1 for the right eye, 0 for the left, null otherwise."""
    s = F.upper(c)
    return F.when(s.isin("OD", "R"), F.lit(1)).when(s.isin("OS", "L"), F.lit(0))
