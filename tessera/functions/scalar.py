"""Scalar column expressions used by the loads, cleaning jobs and models.

Every function here returns a ``Column`` built from ``pyspark.sql.functions``
so it stays inside whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean equatorial radius used by great-circle distance (metres),
# the age-bucket labels and bounds of the customer profile.
EARTH_RADIUS_M = 6378137.0
AGE_UNDER = "Under 25"
AGE_MIDDLE = "25-40"
AGE_OVER = "Over 40"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_years(birthday, as_of: date) -> Column:
    """Whole years between ``birthday`` and ``as_of`` (truncated month difference / 12)."""
    months = F.months_between(F.lit(as_of), col(birthday))
    return F.floor(months / F.lit(12)).cast("bigint")


def age_bucket(birthday, as_of: date) -> Column:
    """'Under 25' / '25-40' / 'Over 40'; a NULL birthday falls to 'Over 40' (ELSE branch)."""
    age = age_years(birthday, as_of)
    return (F.when(age < 25, AGE_UNDER)
             .when(age.between(25, 40), AGE_MIDDLE)
             .otherwise(AGE_OVER))


def guarded_ratio(num, den) -> Column:
    """num / den, NULL when the divisor is NULL or zero (no ANSI divide-by-zero failure)."""
    d = col(den)
    return F.when(d.isNotNull() & (d != 0), col(num) / d)


def pct_change(cur, prev) -> Column:
    """(cur - prev) / prev * 100, NULL when prev is NULL or 0."""
    p = col(prev)
    return F.when(p.isNotNull() & (p != 0), (col(cur) - p) / p * F.lit(100.0))


def lenient_cast(c: str, to: str) -> Column:
    """Text to ``to``; unreadable text and '' become NULL instead of failing the job
    (R's ``as.numeric`` gives NA; an ANSI ``cast`` would abort)."""
    return F.expr(f"try_cast(nullif(trim(`{c}`), '') AS {to})")


def haversine_m(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres (haversine, atan2 form, spherical earth)."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlat = p2 - p1
    dlon = F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / F.lit(1000.0)


def round_to_day(ts) -> Column:
    """Round a timestamp to the nearest day, halves up."""
    return F.date_trunc("day", col(ts) + F.expr("INTERVAL 12 HOURS"))


def epoch_to_day(seconds) -> Column:
    """Epoch seconds to the nearest day (the ratings files store epoch integers)."""
    return round_to_day(F.timestamp_seconds(col(seconds)))


def title_year(title) -> Column:
    """Four digits in brackets, e.g. 'Heat (1995)' -> 1995; NULL when absent."""
    raw = F.regexp_extract(col(title), r"\((\d{4})\)", 1)
    return F.when(raw != "", raw.cast("int"))


def truncate_label(s, n: int = 15) -> Column:
    return F.substring(col(s), 1, n)


def month_start(d) -> Column:
    return F.trunc(col(d), "MM")


def binarize(c, threshold) -> Column:
    return (col(c) > threshold).cast("int")


def significant(c, digits: int = 6) -> Column:
    """A number rounded to so many significant digits (NULL stays NULL)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double"))
