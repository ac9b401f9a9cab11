"""Spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = 180.0 * 3600.0 / math.pi


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """Unit vector of right ascension and declination in degrees."""
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def separation(u: tuple[Column, Column, Column], v: tuple[Column, Column, Column]) -> Column:
    """Angle in arcsec between unit vectors, stable at all angles: atan2(|u x v|, u . v)."""
    (a, b, c), (x, y, z) = u, v
    cross = F.sqrt((b * z - c * y) * (b * z - c * y) + (c * x - a * z) * (c * x - a * z) + (a * y - b * x) * (a * y - b * x))
    return F.atan2(cross, a * x + b * y + c * z) * ARCSEC


def cosine_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle in arcsec by the law of cosines, clamped; only for offsets that need not be exact below 0.01 arcsec."""
    a1, d1, a2, d2 = (F.radians(c) for c in (ra1, dec1, ra2, dec2))
    dot = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(a1 - a2)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))) * 3600.0
