"""Turning raw tag and probe values into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediacat import fixed
from mediacat.functions import times


def _found(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern, NULL where the pattern does not occur.

    NULL rather than empty text, since a cast that fails is slow.
    """
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def rational(value: Column) -> Column:
    """A number, or ``n/d`` as a fraction; a zero denominator gives NULL."""
    parts = F.split(value, "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return (
        F.when(F.size(parts) == 1, value.try_cast("double"))
        .when((F.size(parts) == 2) & (bottom != 0), top / bottom)
    )


def gps_dms(parts: Column, ref: Column) -> Column:
    """Degrees from [degrees, minutes, seconds]; south and west are negative."""
    degrees = (
        rational(F.get(parts, F.lit(0)))
        + rational(F.get(parts, F.lit(1))) / F.lit(60.0)
        + rational(F.get(parts, F.lit(2))) / F.lit(3600.0)
    )
    sign = F.when(ref.isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when((F.size(parts) >= 3) & ref.isNotNull(), degrees * sign)


def gps_text(text: Column) -> Column:
    """Degrees from ``37 deg 46' 29.64" N`` or from a decimal whose letter is dropped."""

    def group(index: int) -> Column:
        return _found(text, fixed.DEGREES_PATTERN, index)

    degrees = (
        group(1).try_cast("double")
        + group(2).try_cast("double") / F.lit(60.0)
        + group(3).try_cast("double") / F.lit(3600.0)
    )
    signed = degrees * F.when(group(4).isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0))
    decimal = F.regexp_replace(text, r"[NSEW ]+\z", "").try_cast("double")
    return F.when(F.contains(text, F.lit("deg")), signed).otherwise(decimal)


def altitude_text(text: Column) -> Column:
    """Leading number, negative when the text says below."""
    number = _found(text, fixed.ALTITUDE_PATTERN, 1).try_cast("double")
    return F.when(F.contains(F.lower(text), F.lit("below")), -number).otherwise(number)


def altitude_ref(value: Column, ref: Column) -> Column:
    """Altitude with its reference byte: 1 means below sea level."""
    height = rational(value)
    return F.when(ref == 1, -height).otherwise(height)


def number_with_unit(text: Column) -> Column:
    """First space-separated part as a number: ``50.0 mm`` gives 50.0."""
    return F.split_part(F.trim(text), F.lit(" "), F.lit(1)).try_cast("double")


def exposure(value: Column) -> Column:
    """``n/d`` stays a fraction, a number stays its text."""
    return F.regexp_replace(value, r"\s+", "")


def flash(bits: Column) -> Column:
    fired = F.getbit(bits.cast("bigint"), F.lit(0)) == 1
    return F.when(bits.isNotNull(), F.when(fired, "Flash fired").otherwise("Flash did not fire"))


def white_balance(value: Column) -> Column:
    return F.when(value.isNotNull(), F.when(value == 0, "Auto").otherwise("Manual"))


def orientation(text: Column) -> Column:
    """First digits in the text."""
    return _found(text, r"\d+", 0).try_cast("int")


def valid_orientation(value: Column) -> Column:
    """NULL outside 1..8."""
    return F.when(value.between(1, 8), value)


def frame_rate(text: Column) -> Column:
    """``30000/1001`` or a plain number."""
    return rational(text)


def _label(text: Column, number_form) -> Column:
    """Tag readers print either the number or its meaning; numbers are spelled out."""
    number = _found(text, r"^\s*(\d+)\s*$", 1).try_cast("bigint")
    return F.when(number.isNotNull(), number_form(number)).otherwise(text)


def tag_columns(tags: Column) -> list[Column]:
    """Named columns of one tag map (text values)."""

    def tag(name: str) -> Column:
        return F.try_element_at(tags, F.lit(name))

    original = times.exif_time(tag("DateTimeOriginal"))
    digitized = F.when(tag("DateTimeOriginal").isNull(), times.exif_time(tag("CreateDate")))
    return [
        original.alias("datetime_original"),
        digitized.alias("datetime_digitized"),
        gps_text(tag("GPSLatitude")).alias("gps_latitude"),
        gps_text(tag("GPSLongitude")).alias("gps_longitude"),
        altitude_text(tag("GPSAltitude")).alias("gps_altitude"),
        F.trim(tag("Make")).alias("camera_make"),
        F.trim(tag("Model")).alias("camera_model"),
        F.trim(tag("LensMake")).alias("lens_make"),
        F.trim(tag("LensModel")).alias("lens_model"),
        number_with_unit(tag("FocalLength")).alias("focal_length"),
        number_with_unit(tag("FNumber")).alias("f_number"),
        tag("ExposureTime").alias("exposure_time"),
        tag("ISO").try_cast("int").alias("iso"),
        orientation(tag("Orientation")).alias("orientation"),
        _label(tag("Flash"), flash).alias("flash"),
        _label(tag("WhiteBalance"), white_balance).alias("white_balance"),
        tag("ImageWidth").try_cast("int").alias("exif_width"),
        tag("ImageHeight").try_cast("int").alias("exif_height"),
    ]


def probe_columns(fmt: Column, streams: Column) -> list[Column]:
    """Duration of the container and size and rate of its first video stream."""
    video = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = F.when(video["r_frame_rate"].isNotNull(), video["r_frame_rate"]).otherwise(
        video["avg_frame_rate"]
    )
    return [
        fmt["duration"].try_cast("double").alias("duration_seconds"),
        frame_rate(rate).alias("frame_rate"),
        video["width"].alias("video_width"),
        video["height"].alias("video_height"),
    ]
