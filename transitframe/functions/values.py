"""Times, numbers and coordinate lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transitframe.functions import text as tx


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def minutes(value: Column | str) -> Column:
    """Minute of day of ``HH:MM``."""
    parts = F.split(_col(value), ":")
    return F.get(parts, 0).try_cast("int") * 60 + F.get(parts, 1).try_cast("int")


def valid_time(hour: Column, minute: Column) -> Column:
    """Zero-padded time, null outside 00:00-23:59."""
    h, m = hour.try_cast("int"), minute.try_cast("int")
    return F.when(h.between(0, 23) & m.between(0, 59), F.format_string("%02d:%02d", h, m))


def times_in(text: Column | str, strict: bool = True) -> Column:
    """Every time of a text; ``strict`` checks the range and returns a sorted set."""
    if not strict:
        return F.regexp_extract_all(_col(text), F.lit(r"\b(\d{2}:\d{2})\b"), F.lit(1))
    found = F.regexp_extract_all(_col(text), F.lit(r"\b([0-2]\d:[0-5]\d)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: F.substring(t, 1, 2) <= "23")))


def times_near(times: Column, target: int | Column, window: int) -> Column:
    """T4: times within ``window`` minutes of ``target`` (no wrap at midnight)."""
    goal = target if isinstance(target, Column) else F.lit(target)
    return F.filter(times, lambda t: F.abs(minutes(t) - goal) <= window)


def decimal_comma(value: Column | str) -> Column:
    """M1: number written with a decimal comma, null on failure."""
    return F.replace(_col(value), F.lit(","), F.lit(".")).try_cast("double")


def int_or_zero(value: Column | str) -> Column:
    """M1: integer part, 0 on failure."""
    return F.coalesce(_col(value).try_cast("double").try_cast("int"), F.lit(0))


def parse_coordinates(value: Column | str, strict: bool = False) -> Column:
    """M2: ``lon,lat[,alt]`` tokens to an array of struct(lat, lon).

    Lenient mode drops tokens that are not numbers; strict mode raises on them.
    """
    tokens = F.filter(F.split(tx.strip(value), r"\s+"), lambda t: F.size(F.split(t, ",")) >= 2)
    cast = (lambda c: c.cast("double")) if strict else (lambda c: c.try_cast("double"))
    points = F.transform(
        tokens,
        lambda t: F.struct(
            cast(F.btrim(F.get(F.split(t, ","), 1))).alias("lat"), cast(F.btrim(F.get(F.split(t, ","), 0))).alias("lon")
        ),
    )
    return points if strict else F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def in_range(lat: Column, lon: Column) -> Column:
    """M3: coordinates inside the valid range."""
    return lat.between(-90, 90) & lon.between(-180, 180)


def checked_points(points: Column, label: Column) -> Column:
    """M3: the same points, or an error naming the record with an invalid coordinate."""
    good = F.forall(points, lambda p: in_range(p["lat"], p["lon"]))
    return F.when(good, points).otherwise(
        F.raise_error(F.concat(F.lit("coordinates out of range: "), label)).cast("array<struct<lat:double,lon:double>>")
    )


def swap_axes(coordinates: Column) -> Column:
    """M4: ``[lat, lon]`` arrays to ``[lon, lat]``; points with fewer than two numbers are dropped."""
    return F.transform(
        F.filter(coordinates, lambda p: F.size(p) >= 2), lambda p: F.array(F.get(p, 1), F.get(p, 0))
    )


def cache_key(lat: Column, lon: Column) -> Column:
    """M5: geocode cache key at six decimals."""
    return F.concat_ws(",", F.round(lat, 6).cast("string"), F.round(lon, 6).cast("string"))


def with_extra(base: Column, extra: Column) -> Column:
    """M6: base plus an optional extra."""
    return base + F.coalesce(extra, F.lit(0))


def close_ring(ring: Column) -> Column:
    """A2: repeat the first vertex at the end unless the ring is already closed."""
    return F.when((F.size(ring) > 0) & (F.get(ring, 0) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
