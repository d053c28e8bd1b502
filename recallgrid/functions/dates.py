"""Day numbers from ISO text, validity intervals, and phrases like 'two weeks ago'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A phrase, the days it goes back (None: a number in the phrase times the unit), the tolerance in days.
AGO = (
    (r"(\d+)\s+days?\s+ago", 1, 2), (r"a\s+couple\s+(?:of\s+)?days?\s+ago", None, 2), (r"yesterday", None, 1), (r"a\s+week\s+ago", None, 3), (r"(\d+)\s+weeks?\s+ago", 7, 5),
    (r"last\s+week", None, 3), (r"a\s+month\s+ago", None, 7), (r"(\d+)\s+months?\s+ago", 30, 10), (r"last\s+month", None, 7), (r"last\s+year", None, 30), (r"a\s+year\s+ago", None, 30), (r"recently", None, 14),
)
_FIXED = {r"a\s+couple\s+(?:of\s+)?days?\s+ago": 2, "yesterday": 1, r"a\s+week\s+ago": 7, r"last\s+week": 7, r"a\s+month\s+ago": 30, r"last\s+month": 30, r"last\s+year": 365, r"a\s+year\s+ago": 365, "recently": 14}


def iso_to_days(iso: Column) -> Column:
    """Days since 1970, 0 where unknown or earlier; anything behind the date, a zone too, is ignored."""
    return F.greatest(F.lit(0), F.coalesce(F.unix_date(F.try_to_timestamp(F.substring(iso, 1, 10), F.lit("yyyy-MM-dd")).cast("date")), F.lit(0)))


def days_to_iso(days: Column) -> Column:
    return F.when(days > 0, F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd")).otherwise("")


def within(day: Column, since: int | None, until: int | None) -> Column:
    """Both ends included; 0 or None leaves an end open."""
    out = F.lit(True)
    if since:
        out = out & (day >= since)
    return out & (day <= until) if until else out


def valid_on(start: Column, end: Column, day) -> Column:
    """Open where null; both ends included. Works on day numbers and on ISO text alike."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))


def days_ago(question: Column) -> Column:
    """struct(days, tolerance) of the first phrase of AGO in the text; null without any."""
    low, out = F.lower(question), None
    for pattern, unit, tolerance in AGO:
        days = F.regexp_extract(low, pattern, 1).cast("int") * unit if unit else F.lit(_FIXED[pattern])
        found = F.struct(days.alias("days"), F.lit(tolerance).alias("tolerance"))
        out = F.when(low.rlike(pattern), found) if out is None else out.when(low.rlike(pattern), found)
    return out


def proximity_boost(distance: Column, tolerance: Column, most: float = 0.4) -> Column:
    """most within the tolerance, falling to 0 at three times it."""
    return F.when(distance <= tolerance, F.lit(most)).when(distance >= 3 * tolerance, F.lit(0.0)).otherwise(most * (3 * tolerance - distance) / (2 * tolerance))
