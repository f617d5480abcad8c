"""Column functions of the cube algebra. Nulls stay null; ANSI division is guarded."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, digits: int = 4) -> Column:
    """Rounded for output; never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def magnus_es(t_c: Column) -> Column:
    """Saturation vapour pressure in hPa over water (Magnus form)."""
    return 6.112 * F.exp(17.67 * t_c / (t_c + 243.5))


def vpd(t_c: Column, rh_pct: Column) -> Column:
    """Vapour pressure deficit in kPa."""
    return magnus_es(t_c) * (1 - rh_pct / 100.0) / 10.0


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))  # least and greatest skip nulls


def quantize(c: Column, scale: float, nodata: int, low: int = -32767, high: int = 32767) -> Column:
    """Integer code by half-even rounding, clipped; null becomes ``nodata``."""
    return F.coalesce(clip(F.rint(c / scale), low, high).cast("int"), F.lit(nodata))


def dequantize(code: Column, scale: float, nodata: int) -> Column:
    return F.when(code != nodata, code * scale)


def significant(c: Column, digits: int) -> Column:
    """Rounded to a number of significant digits; 0 stays 0."""
    e = F.floor(F.log10(F.abs(c)))
    unit = F.pow(F.lit(10.0), e - (digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c / unit) * unit)


def simplex_rescale(part: Column, old_built: Column, new_built: Column) -> Column:
    """A land-cover share rescaled so that shares and the new built share add up to 1; 0 where the old one leaves nothing."""
    return F.when(old_built >= 0.999, F.lit(0.0)).otherwise(part / (1 - F.least(old_built, F.lit(0.999))) * (1 - new_built))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: The WGS84 ellipsoid and the scale on a UTM zone's central meridian.
A_WGS84, F_WGS84, K0 = 6378137.0, 1 / 298.257223563, 0.9996

_N = F_WGS84 / (2 - F_WGS84)  # third flattening
_RADIUS = K0 * A_WGS84 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of Krueger's series in the third flattening (conformal sphere to plane, back, and conformal to geodetic latitude).
TO_PLANE = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
FROM_PLANE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
TO_GEODETIC = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _harmonics(coefficients: tuple[float, ...], term) -> Column:
    return sum((c * term(2.0 * j) for j, c in enumerate(coefficients, 1)), F.lit(0.0))


def utm_forward(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (m) on the northern half: latitude to the conformal sphere, a transverse sphere, and Krueger's series."""
    lam = F.radians(lon) - math.radians(6 * zone - 183)
    ecc = 2 * math.sqrt(_N) / (1 + _N)
    conformal = F.sinh(F.atanh(F.sin(F.radians(lat))) - ecc * F.atanh(ecc * F.sin(F.radians(lat))))
    up = F.atan2(conformal, F.cos(lam))
    over = F.atanh(F.sin(lam) / F.sqrt(1 + conformal * conformal))
    east = over + _harmonics(TO_PLANE, lambda k: F.cos(k * up) * F.sinh(k * over))
    north = up + _harmonics(TO_PLANE, lambda k: F.sin(k * up) * F.cosh(k * over))
    return 500000.0 + _RADIUS * east, _RADIUS * north


def utm_inverse(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Latitude and longitude (degrees) of a point on the northern half."""
    x, y = (east - 500000.0) / _RADIUS, north / _RADIUS
    up = y - _harmonics(FROM_PLANE, lambda k: F.sin(k * y) * F.cosh(k * x))
    over = x - _harmonics(FROM_PLANE, lambda k: F.cos(k * y) * F.sinh(k * x))
    conformal = F.asin(F.sin(up) / F.cosh(over))
    lat = conformal + _harmonics(TO_GEODETIC, lambda k: F.sin(k * conformal))
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(over), F.cos(up))) + (6 * zone - 183)


def folded(lat: Column) -> tuple[Column, Column]:
    """A latitude of any number of degrees as one from -90 to 90, and the half-turns that it was folded by."""
    turns = F.floor((lat + 90) / 180)
    return F.when(turns % 2 == 0, lat - 180 * turns).otherwise(180 * turns - lat), turns


def unfolded(lat: Column, turns: Column) -> Column:
    """The latitude that ``folded`` began with."""
    return 180 * turns + F.when(turns % 2 == 0, lat).otherwise(-lat)


def normal_name(c: Column) -> Column:
    """Lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]+", " "), r" +", " "))


def unit_hash(a: Column, b: Column) -> Column:
    """A portable hash of two longs to [0, 1]: the same in any engine with 64-bit integers."""
    left = (a * 73856093 + b * 19349663) % 2147483647
    right = (a * 83492791 + b * 2654435) % 1000003 + 1
    return ((left * right) % 2147483647) / F.lit(2147483647.0)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lerp(a: Column, b: Column, m: Column) -> Column:
    """a at m <= 0, b at m >= 1; in between both must be there."""
    return F.when(m <= 0, a).when(m >= 1, b).otherwise(a + (b - a) * m)
