"""Dates in the forms that records use, as column expressions. What isn't a date is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months and how they are shortened.
MONTHS = {
    "ian": 1, "ianuarie": 1, "feb": 2, "februarie": 2, "mar": 3, "mart": 3, "martie": 3, "apr": 4, "aprilie": 4, "mai": 5,
    "iun": 6, "iunie": 6, "iul": 7, "iulie": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "septembrie": 9,
    "oct": 10, "octombrie": 10, "noi": 11, "nov": 11, "noiembrie": 11, "dec": 12, "decembrie": 12,
}


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.nullif(year.cast("string"), F.lit("")), month.cast("string"), F.nullif(day.cast("string"), F.lit(""))), "y-M-d")


def day_first_date(c: Column, short_years: bool = False) -> Column:
    """A date from a leading day, month and year with points, bars or hyphens between.

    With ``short_years``, two digits are a year of this century.
    """
    pattern = rf"^\s*(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}{'|[0-9]{2}(?![0-9])' if short_years else ''})"
    day, month, year = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    return _date(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), month, day)


def month_number(name: Column, whole: bool = False) -> Column:
    """1 to 12 from the name of a month, or its first letters unless ``whole``; marks and a final point don't matter."""
    known = F.create_map(*[F.lit(x) for name_, n in MONTHS.items() if not whole or len(name_) > 4 or name_ == "mai" for x in (name_, n)])
    key = F.translate(F.lower(F.rtrim(name, F.lit("."))), "şţșț", "stst")
    return F.try_element_at(known, key) if whole else F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.substring(key, 1, 3)))


def named_month_date(c: Column) -> Column:
    """The first date written as day, name of the month and year."""
    pattern = r"(?iu)(\d{1,2})\s+([a-zăâîșțşţ]+\.?)\s+(\d{4})"
    return _date(F.regexp_extract(c, pattern, 3), month_number(F.regexp_extract(c, pattern, 2)), F.regexp_extract(c, pattern, 1))


def title_dates(c: Column) -> Column:
    """``start, end`` of the days that a title names: a range within a month, else one day with a null end."""
    span = r"(?iu)(\d{1,2})\s*[-–]\s*(\d{1,2})\s+([a-zăâîșț]+)\s+(\d{4})"
    one = r"(?iu)(\d{1,2})\s+([a-zăâîșț]+)\s+(\d{4})"
    part = lambda pattern, k: F.regexp_extract(c, pattern, k)
    first, last = (_date(part(span, 4), month_number(part(span, 3), True), part(span, k)) for k in (1, 2))
    single = _date(part(one, 3), month_number(part(one, 2), True), part(one, 1))
    both = first.isNotNull() & last.isNotNull()
    return F.struct(F.when(both, first).otherwise(single).alias("start"), F.when(both, last).alias("end"))


def iso_instant(c: Column) -> Column:
    """A timestamp from an ISO date and time, or the midnight of an ISO date; without a zone it is the session's."""
    t = F.trim(c)
    return F.when(F.contains(t, F.lit("T")), t.try_cast("timestamp")).otherwise(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd").cast("timestamp")))


def vote_instant(c: Column) -> Column:
    """A timestamp from day.month.year hour:minute[:second]."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("d.M.yyyy H:mm:ss")), F.try_to_timestamp(c, F.lit("d.M.yyyy H:mm")))


def answer_days(asked: Column, answered: Column, below: int = 730) -> Column:
    """Whole days to an answer; null unless there are more than none and fewer than ``below``."""
    days = F.datediff(answered, asked)
    return F.when((days > 0) & (days < below), days)
