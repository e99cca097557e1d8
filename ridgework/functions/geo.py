"""Reprojection of longitude/latitude to Web Mercator as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ridgework.grid import EARTH_RADIUS


def to_web_mercator(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    lon, lat = (F.col(v) if isinstance(v, str) else v for v in (lon, lat))
    x = lon * F.lit(math.pi * EARTH_RADIUS / 180.0)
    y = F.lit(EARTH_RADIUS) * F.ln(F.tan(F.radians(F.lit(45.0) + lat / F.lit(2.0))))
    return x, y
