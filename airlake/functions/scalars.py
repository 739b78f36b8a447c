"""Column functions: codes, dates, clipping, error classes and map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of error texts of a remote service, in lower case, that are worth another attempt.
RETRYABLE = ("429", "quota", "rate", "unavailable", "deadline", "timeout", "internal", "500", "503")
#: Error texts of a week without images.
NO_IMAGES = ("has no bands", "Parameter 'image' is required")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zfill(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer texts stay whole (lpad alone would cut them)."""
    c = _col(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def station_id(state: Column | str, county: Column | str, site: Column | str) -> Column:
    return F.concat(zfill(state, 2), F.lit("-"), zfill(county, 3), F.lit("-"), zfill(site, 4))


def clip_lower(c: Column | str, floor: float = 0.0) -> Column:
    """``greatest`` would turn a null into the floor; here it stays null."""
    c = _col(c)
    return F.when(c < floor, F.lit(floor)).otherwise(c)


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def week_start(c: Column | str) -> Column:
    """Monday of the ISO week, as a date."""
    return F.trunc(_col(c).cast("date"), "week")


def hour_of(c: Column | str) -> Column:
    return F.hour(_col(c))


def iso_week(c: Column | str) -> Column:
    return F.weekofyear(_col(c))


def month_of(c: Column | str) -> Column:
    return F.trunc(_col(c), "month")


def utc_time(date: Column | str, time: Column | str) -> Column:
    return F.to_timestamp_ntz(F.concat_ws(" ", _col(date), _col(time)), F.lit("yyyy-MM-dd HH:mm"))


def millis_to_utc(ms: Column | str) -> Column:
    return F.timestamp_millis(_col(ms))


def local_date(ts: Column | str, zone: str = "America/Los_Angeles") -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts).cast("timestamp_ntz")))


def day_to_date(day: Column | str) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _col(day).cast("int"))


def log_target(y: Column | str) -> Column:
    return F.log1p(clip_lower(y))


def exceeds(y: Column | str, threshold: float) -> Column:
    return (_col(y) > threshold).cast("int")


def logistic(x: Column | str, centre: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-(_col(x) - centre) / scale))


def error_status(message: Column | str) -> Column:
    """no_images, retry or error, by the text of a failure; a missing text is an error."""
    m = _col(message)
    empty = m.contains(NO_IMAGES[0]) | m.contains(NO_IMAGES[1])
    return F.when(empty, "no_images").when(F.regexp_like(F.lower(m), F.lit("|".join(RETRYABLE))), "retry").otherwise("error")


def short_message(message: Column | str, length: int = 300) -> Column:
    return F.substring(_col(message), 1, length)


def utm_epsg(lon: Column | str) -> Column:
    """Code of the northern UTM zone of a longitude."""
    return (F.lit(32600) + F.floor((_col(lon) + 180) / 6) + 1).cast("int")


def to_utm(lat: Column | str, lon: Column | str, epsg: Column | str) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series to third order (WGS 84)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    c = 2 * math.sqrt(n) / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, zone = F.radians(_col(lat)), _col(epsg) - 32600
    lam = F.radians(_col(lon) - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, w in enumerate(alpha, 1):
        east = east + w * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + w * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, 0.9996 * radius * north


def bbox(lat: Column | str, lon: Column | str, size: int = 224, scale: float = 10.0) -> list[Column]:
    half = size * scale / 2 / 111000 * 1.5
    return [(_col(lon) - half).alias("west"), (_col(lat) - half).alias("south"), (_col(lon) + half).alias("east"), (_col(lat) + half).alias("north")]


def draw(seed: int, *keys: Column | str) -> Column:
    """A reproducible random hex text of the keys, the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed))))
