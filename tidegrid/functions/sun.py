"""Sun position and clear-sky irradiance as column arithmetic (published NOAA and Haurwitz formulas)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.timecols import as_col


def _series(g: Column, const: float, terms) -> Column:
    out = F.lit(const)
    for n, (c, s) in enumerate(terms, start=1):
        out = out + c * F.cos(n * g) + s * F.sin(n * g)
    return out


def sun_elevation(ts, lat: float, lon: float, refraction: bool = True) -> Column:
    """Degrees above the horizon at a UTC instant."""
    t = as_col(ts)
    minutes = F.hour(t) * 60.0 + F.minute(t) + F.second(t) / 60.0
    g = (2 * math.pi / 365.0) * (F.dayofyear(t) - 1 + (minutes / 60.0 - 12.0) / 24.0)
    eqtime = 229.18 * _series(g, 0.000075, [(0.001868, -0.032077), (-0.014615, -0.040849)])
    decl = _series(g, 0.006918, [(-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148)])
    hour_angle = F.radians((minutes + eqtime + 4.0 * lon) / 4.0 - 180.0)
    la = math.radians(lat)
    cosz = math.sin(la) * F.sin(decl) + math.cos(la) * F.cos(decl) * F.cos(hour_angle)
    h = 90.0 - F.degrees(F.acos(F.greatest(F.least(cosz, F.lit(1.0)), F.lit(-1.0))))
    if not refraction:
        return h
    tan = F.tan(F.radians(h))
    low = 1735.0 + h * (-518.2 + h * (103.4 + h * (-12.79 + h * 0.711)))
    arcsec = F.when(h > 85, 0.0).when(h > 5, 58.1 / tan - 0.07 / (tan * tan * tan) + 0.000086 / (tan * tan * tan * tan * tan)).when(
        h > -0.575, low).otherwise(-20.774 / tan)
    return h + arcsec / 3600.0


def clear_sky_ghi(elevation) -> Column:
    """Haurwitz irradiance in W/m2, 0 at night."""
    cosz = F.sin(F.radians(as_col(elevation)))
    return F.when(cosz > 0, 1098.0 * cosz * F.exp(-0.057 / cosz)).otherwise(F.lit(0.0))
