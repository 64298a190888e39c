"""Readable numbers, sizes, durations and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units.
UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(n: Column) -> Column:
    """Size with one decimal and the largest fitting unit."""
    size = n.cast("double")
    out = None
    for i, unit in enumerate(UNITS):
        scaled = size / F.lit(1024.0**i)
        text = F.format_string(f"%.1f {unit}", scaled)
        fits = F.abs(scaled) < 1024.0
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out.otherwise(F.format_string("%.1f PB", size / F.lit(1024.0**5)))


def format_duration(seconds: Column) -> Column:
    """Duration with one decimal in the unit that suits it."""
    s = seconds.cast("double")
    return (
        F.when(s < 0.001, F.format_string("%.1fμs", s * 1e6))
        .when(s < 1, F.format_string("%.1fms", s * 1e3))
        .when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.format_string("%.1fm", s / 60.0))
        .otherwise(F.format_string("%.1fh", s / 3600.0))
    )


def format_time(us: Column) -> Column:
    """Microseconds since the epoch as date and time (UTC session)."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


def iso_time(us: Column) -> Column:
    """Microseconds since the epoch in ISO form."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def format_number(n: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(n, 0)
