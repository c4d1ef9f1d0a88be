"""Time expressions. Text times are ISO 8601 in UTC; the session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediacat import fixed

_ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


def iso_text(ts: Column) -> Column:
    """``2021-01-01T00:00:00+00:00`` of a timestamp."""
    return F.date_format(ts, _ISO)


def iso_time(text: Column) -> Column:
    """Timestamp of an ISO text, NULL when it is not one."""
    return F.try_to_timestamp(text)


def epoch_text(seconds: Column) -> Column:
    """ISO text of a count of seconds since 1970, NULL outside years 1 to 9999."""
    inside = seconds.between(fixed.EPOCH_SECONDS_MIN, fixed.EPOCH_SECONDS_MAX)
    return iso_text(F.timestamp_seconds(F.when(inside, seconds)))


def formatted_time(text: Column) -> Column:
    """ISO text of a displayed time such as ``Jan 1, 2020, 12:00:00 AM UTC``.

    Text that is already ISO passes unchanged. Any white space separates parts.
    """
    is_iso = F.contains(text, F.lit("T")) & (
        F.contains(text, F.lit("Z")) | F.contains(text, F.lit("+"))
    )
    spaced = F.regexp_replace(text, r"(?U)\s+", " ")
    local = F.regexp_replace(spaced, r"(?i) UTC\z", "")
    parsed = F.when(
        F.regexp_like(local, F.lit(r"^\d")), F.try_to_timestamp(local, F.lit("yyyy-M-d H:m:s"))
    ).otherwise(F.try_to_timestamp(local, F.lit("MMM d, yyyy, h:mm:ss a")))
    return F.when(is_iso, text).otherwise(iso_text(parsed))


def _name_time(name: Column, pattern: str) -> Column:
    # NULL where the pattern does not occur, so that only real candidates are parsed.
    found = F.nullif(F.regexp_extract(name, pattern, 0), F.lit(""))
    digits = F.rpad(F.regexp_replace(found, "[^0-9]", ""), 14, "0")
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))


def filename_time(name: Column) -> Column:
    """Time written in a file name: the first pattern that gives a real date."""
    return F.coalesce(*[_name_time(name, p) for p in fixed.NAME_TIME_PATTERNS])


def reliable_exif(ts: Column, now: Column) -> Column:
    """False for camera default dates, dates before 1990 and dates over a year ahead."""
    seconds = F.unix_micros(ts) / F.lit(1_000_000)
    near_default = F.lit(False)
    for day in fixed.CAMERA_DEFAULT_TIMES:
        start = F.unix_seconds(F.lit(day).cast("timestamp"))
        near_default = near_default | (
            F.abs(seconds - start) < fixed.CAMERA_DEFAULT_WINDOW_SECONDS
        )
    days_ahead = F.floor((F.unix_micros(ts) - F.unix_micros(now)) / F.lit(86_400_000_000))
    new_year_hour = (
        (F.month(ts) == 1) & (F.dayofmonth(ts) == 1) & (F.minute(ts) == 0) & (F.second(ts) == 0)
    )
    return (
        ts.isNotNull()
        & ~near_default
        & (F.year(ts) >= fixed.EARLIEST_CAMERA_YEAR)
        & (days_ahead <= fixed.MAX_FUTURE_DAYS)
        & ~new_year_hour
    )


def capture_time(
    original: Column,
    digitized: Column,
    has_taken: Column,
    taken: Column,
    has_creation: Column,
    creation: Column,
    name: Column,
    now: Column,
) -> Column:
    """Time of capture by precedence.

    A reliable EXIF time wins, then the sidecar, then the file name. A sidecar that has
    the key ends the search even when its value could not be read.
    """
    return (
        F.when(reliable_exif(original, now), original)
        .when(reliable_exif(digitized, now), digitized)
        .when(has_taken, taken)
        .when(has_creation, creation)
        .otherwise(filename_time(name))
    )


def exif_time(text: Column) -> Column:
    """Timestamp of ``YYYY:MM:DD hh:mm:ss``; anything but two parts is NULL."""
    parts = F.split(text, " ")
    date, time = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    whole = F.concat(F.translate(date, ":", "-"), F.lit("T"), time, F.lit("+00:00"))
    return F.when(F.size(parts) == 2, F.try_to_timestamp(whole))
