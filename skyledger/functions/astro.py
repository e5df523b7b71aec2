"""Astronomy as native column expressions: Julian day, sidereal time, sun, altitude, airmass, separation, optics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RAD = math.pi / 180


def julian_day(micros: Column) -> Column:
    """Of an instant in micros since 1970 (UTC)."""
    return micros / 86_400_000_000 + 2440587.5


def sidereal(jd: Column) -> Column:
    """Greenwich mean sidereal time in degrees."""
    d = jd - 2451545.0
    t = d / 36525.0
    angle = 280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0
    return angle - 360.0 * F.floor(angle / 360.0)


def sun(jd: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the sun in degrees, to about a hundredth."""
    n = jd - 2451545.0
    g = (357.528 + 0.9856003 * n) * RAD
    lon = (280.460 + 0.9856474 * n + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g)) * RAD
    tilt = (23.439 - 0.0000004 * n) * RAD
    ra = F.atan2(F.cos(tilt) * F.sin(lon), F.cos(lon)) / RAD
    return ra - 360.0 * F.floor(ra / 360.0), F.asin(F.sin(tilt) * F.sin(lon)) / RAD


def altitude(ra: Column, dec: Column, lat: Column, lon: Column, jd: Column) -> Column:
    """Degrees above the horizon; lon east."""
    h = (sidereal(jd) + lon - ra) * RAD
    return F.asin(F.sin(dec * RAD) * F.sin(lat * RAD) + F.cos(dec * RAD) * F.cos(lat * RAD) * F.cos(h)) / RAD


def azimuth(ra: Column, dec: Column, lat: Column, lon: Column, jd: Column) -> Column:
    """Degrees from north through east; lon east."""
    h = (sidereal(jd) + lon - ra) * RAD
    a = F.atan2(-F.cos(dec * RAD) * F.sin(h), F.sin(dec * RAD) * F.cos(lat * RAD) - F.cos(dec * RAD) * F.cos(h) * F.sin(lat * RAD)) / RAD
    return wrapped(a)


def wrapped(degrees: Column) -> Column:
    return degrees - 360.0 * F.floor(degrees / 360.0)


# Terms of the low-precision lunar series (amplitude, phase, rate per century), of longitude and latitude.
MOON_LON = [(6.29, 135.0, 477198.87), (-1.27, 259.3, -413335.36), (0.66, 235.7, 890534.22), (0.21, 269.9, 954397.74), (-0.19, 357.5, 35999.05), (-0.11, 186.5, 966404.03)]
MOON_LAT = [(5.13, 93.3, 483202.02), (0.28, 228.2, 960400.89), (-0.28, 318.3, 6003.15), (-0.17, 217.6, -407332.21)]


def _moon_ecliptic(jd: Column) -> tuple[Column, Column]:
    t = (jd - 2451545.0) / 36525.0
    series = lambda terms: sum((k * F.sin((a + b * t) * RAD) for k, a, b in terms), F.lit(0.0))
    return wrapped(218.32 + 481267.881 * t + series(MOON_LON)), series(MOON_LAT)


def moon(jd: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the moon in degrees, to some tenths."""
    lon, lat = (x * RAD for x in _moon_ecliptic(jd))
    tilt = (23.439291 - 0.0130042 * (jd - 2451545.0) / 36525.0) * RAD
    ra = F.atan2(F.sin(lon) * F.cos(tilt) - F.tan(lat) * F.sin(tilt), F.cos(lon)) / RAD
    return wrapped(ra), F.asin(F.sin(lat) * F.cos(tilt) + F.cos(lat) * F.sin(tilt) * F.sin(lon)) / RAD


def sun_longitude(jd: Column) -> Column:
    """Ecliptic longitude of the sun in degrees."""
    t = (jd - 2451545.0) / 36525.0
    m = (357.52911 + 35999.05029 * t) * RAD
    return wrapped(280.46646 + 36000.76983 * t + (1.914602 - 0.004817 * t) * F.sin(m) + 0.019993 * F.sin(2 * m) + 0.000289 * F.sin(3 * m))


def moon_phase(jd: Column) -> tuple[Column, Column]:
    """The lit share of the moon (0 new, 1 full), and whether it grows."""
    lon, lat = _moon_ecliptic(jd)
    apart = lon - sun_longitude(jd)
    return (1 - F.cos(lat * RAD) * F.cos(apart * RAD)) / 2, wrapped(apart) < 180


def cd_matrix(cd11: Column, cd12: Column, cd21: Column, cd22: Column, cdelt1: Column, cdelt2: Column, crota2: Column, has_ctype1: Column) -> Column:
    """The linear terms of a plate solution, degrees a pixel: a, b, c, d; from CDi_j, else from CDELTn and CROTA2 where CTYPE1 is there; else null."""
    r, zero = F.coalesce(crota2, F.lit(0.0)) * RAD, F.lit(0.0)
    pack = lambda a, b, c, d: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    turned = pack(cdelt1 * F.cos(r), -cdelt2 * F.sin(r), cdelt1 * F.sin(r), cdelt2 * F.cos(r))
    return F.when(cd11.isNotNull() & cd22.isNotNull(), pack(cd11, F.coalesce(cd12, zero), F.coalesce(cd21, zero), cd22)).when(cdelt1.isNotNull() & cdelt2.isNotNull() & has_ctype1, turned)


def wcs_scale(cd: Column) -> Column:
    """Arc seconds a pixel of a CD matrix; null if it is singular."""
    det = F.abs(cd["a"] * cd["d"] - cd["b"] * cd["c"])
    return F.when(det > 0, F.sqrt(det) * 3600)


def field_of_view(scale: Column, pixels: Column) -> Column:
    """Arc minutes."""
    return scale * pixels / 60.0


def pixel_to_sky(x: Column, y: Column, crval1: Column, crval2: Column, crpix1: Column, crpix2: Column, cd: Column) -> tuple[Column, Column]:
    """Right ascension and declination of a pixel counted from 0, by the gnomonic projection."""
    dx, dy = x + 1.0 - crpix1, y + 1.0 - crpix2
    xi, eta = (cd["a"] * dx + cd["b"] * dy) * RAD, (cd["c"] * dx + cd["d"] * dy) * RAD
    ra0, dec0 = crval1 * RAD, crval2 * RAD
    den = F.cos(dec0) - eta * F.sin(dec0)
    ra = (ra0 + F.atan2(xi, den)) / RAD
    return wrapped(ra), F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + den * den)) / RAD


def rotation(cd: Column) -> Column:
    """Position angle of the image's upward direction, east of north, in degrees."""
    return wrapped(F.atan2(-cd["b"], cd["d"]) / RAD)


def moved_solution(crpix1: Column, crpix2: Column, cd: Column, how: str, x: float = 0.0, y: float = 0.0) -> tuple[Column, Column, Column]:
    """crpix1, crpix2 and CD matrix of an image that is cut ('crop' from pixel x, y), resampled ('scale' by x), mirrored
    ('flip_columns' of width x, 'flip_rows' of height y) or turned clockwise by 90 degrees ('rotate' of height y)."""
    pack = lambda a, b, c, d: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    a, b, c, d = (cd[k] for k in "abcd")
    if how == "crop":
        return crpix1 - x, crpix2 - y, cd
    if how == "scale":
        return (crpix1 - 0.5) * x + 0.5, (crpix2 - 0.5) * x + 0.5, pack(a / x, b / x, c / x, d / x)
    if how == "flip_columns":
        return x + 1.0 - crpix1, crpix2, pack(-a, b, -c, d)
    if how == "flip_rows":
        return crpix1, y + 1.0 - crpix2, pack(a, -b, c, -d)
    if how == "rotate":
        return y + 1.0 - crpix2, crpix1, pack(-b, a, -d, c)
    raise ValueError(how)


def airmass(alt: Column) -> Column:
    """Kasten and Young 1989; null at or below the horizon."""
    return F.when(alt > 0, 1 / (F.sin(alt * RAD) + 0.50572 * F.pow(alt + 6.07995, F.lit(-1.6364))))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees between two positions."""
    a = F.pow(F.sin((dec2 - dec1) * RAD / 2), F.lit(2.0)) + F.cos(dec1 * RAD) * F.cos(dec2 * RAD) * F.pow(F.sin((ra2 - ra1) * RAD / 2), F.lit(2.0))
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a))) / RAD


def pixel_scale(pixel_um: Column, focal_mm: Column) -> Column:
    """Arc seconds a pixel."""
    return F.when(focal_mm > 0, 206.264806 * pixel_um / focal_mm)


def sampling(scale: Column) -> Column:
    return F.when(scale < 0.8, "over").when(scale <= 2.0, "well").when(scale.isNotNull(), "under")


def sky(sun_alt: Column) -> Column:
    """What the sky is at a sun altitude."""
    return F.when(sun_alt <= -18, "night").when(sun_alt <= -12, "astronomical twilight").when(sun_alt <= -6, "nautical twilight").when(sun_alt <= 0, "civil twilight").otherwise("day")


def session_night(micros: Column, lon: Column) -> Column:
    """The date of the local solar day, noon to noon, that an instant falls into."""
    return F.date_from_unix_date(F.floor(micros / 86_400_000_000 + lon / 360.0 - 0.5).cast("int")).cast("string")
