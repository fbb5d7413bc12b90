"""Text-to-value parsing for raw station files (never raises: bad input gives NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(text) -> Column:
    t = _c(text)
    return F.when(F.trim(t) == "", F.lit(None).cast("string")).otherwise(t)


def parse_date(text) -> Column:
    """``YYYY/MM/DD`` -> timestamp at midnight; anything else -> NULL."""
    return F.try_to_timestamp(_c(text), F.lit("yyyy/MM/dd")).cast("timestamp_ntz")


def hour_digits(text) -> Column:
    """Strip `` UTC`` and left-pad with zeros to 4 characters (never truncates)."""
    h = F.regexp_replace(_c(text).cast("string"), " UTC", "")
    return F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h)


def parse_datetime(date_text, hour_text) -> Column:
    """Date plus HH hours plus MM minutes from the hour text; ``2400`` rolls into the next day.
    NULL when the date or either hour part does not parse."""
    h = hour_digits(hour_text)
    hours = F.substring(h, 1, 2).try_cast("int")
    minutes = F.substring(h, 3, 64).try_cast("int")
    base = parse_date(date_text)
    return base + F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0))


def decimal_comma(text) -> Column:
    """``'1,5'`` -> 1.5; text that is not a number, or ``NaN``, -> NULL."""
    v = F.regexp_replace(_c(text).cast("string"), ",", ".").try_cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


def ms_to_kmh(col) -> Column:
    return _c(col) * P.MS_TO_KMH
