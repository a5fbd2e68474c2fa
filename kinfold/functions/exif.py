"""Defensive parsers of capture metadata. All are column expressions: a value that can't be read becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUL_OR_BLANK = "\0 "
#: Fixed value: how a capture date is written.
_DATE = r"^\s*(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})"


def finite(number: Column) -> Column:
    """The number as a double; null for NaN and infinities."""
    x = number.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """The value of a rational; null where the denominator is 0 or either part isn't a finite number."""
    return finite(F.try_divide(finite(numerator), finite(denominator)))


def dms_to_decimal(parts: Column, ref: Column, positive: str, negative: str) -> Column:
    """Degrees from one to three parts (degrees, minutes, seconds) and a hemisphere letter.

    Null for other letters, other numbers of parts, null or negative parts, and minutes or seconds of 60 and more.
    """
    letter = F.upper(F.substring(F.trim(ref.cast("string"), F.lit(_NUL_OR_BLANK)), 1, 1))
    values = F.transform(parts, finite)
    part = lambda i: F.coalesce(F.get(values, F.lit(i)), F.lit(0.0))
    usable = F.size(values).between(1, 3) & F.forall(values, lambda x: F.coalesce(x >= 0, F.lit(False))) & (part(1) < 60) & (part(2) < 60)
    degrees = part(0) + part(1) / 60 + part(2) / 3600
    return F.when(usable & (letter == positive), degrees).when(usable & (letter == negative), -degrees)


def gps(lat: Column, lon: Column) -> Column:
    """A struct (lat, lon) of decimal degrees: both or neither, within range, and not the null island."""
    good = lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def capture_date(text: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` as ISO text; what follows is ignored; null if it is no real calendar time.

    A camera's clock has no zone: the time is judged and kept as it stands, whatever the session's zone.
    """
    clean = F.regexp_replace(text.cast("string"), "\0", "")
    digits = [F.regexp_extract(clean, _DATE, k) for k in range(1, 7)]
    written = F.concat(digits[0], F.lit("-"), digits[1], F.lit("-"), digits[2], F.lit(" "), digits[3], F.lit(":"), digits[4], F.lit(":"), digits[5])
    # Java knows a year 0; a calendar does not.
    real = clean.rlike(_DATE) & (digits[0] != "0000") & written.try_cast("timestamp_ntz").isNotNull()
    return F.when(real, F.replace(written, F.lit(" "), F.lit("T")))


def first_date(*candidates: Column) -> Column:
    """The first candidate that is a valid date: original, digitized, modified."""
    return F.coalesce(*(capture_date(c) for c in candidates))
