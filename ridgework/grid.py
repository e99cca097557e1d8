"""Placement of a tiled raster on the map."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Fixed value: radius in metres of the sphere behind EPSG:3857.
EARTH_RADIUS = 6378137.0


@dataclass(frozen=True)
class Grid:
    """Square cells of side ``res`` counted right and down from ``(xmin, ymax)``.

    A tile holds ``tile_size`` x ``tile_size`` cells in row-major order.
    """

    tile_size: int
    xmin: float
    ymax: float
    res: float
    crs: str = "EPSG:3857"

    def __post_init__(self):
        if self.tile_size < 1:
            raise ValueError("tile_size must be positive")
        if not self.res > 0:
            raise ValueError("res must be positive")

    @classmethod
    def zoomed(cls, zoom: int, tile_size: int = 256) -> "Grid":
        """The world-wide Web Mercator layout with ``2**zoom`` tiles on each side."""
        half = math.pi * EARTH_RADIUS
        return cls(tile_size, -half, half, 2 * half / (tile_size * 2**zoom))

    @property
    def cells_per_tile(self) -> int:
        return self.tile_size * self.tile_size

    def coarser(self, levels: int = 1) -> "Grid":
        """The grid whose cells each cover ``2**levels`` cells of this one per side."""
        return Grid(self.tile_size, self.xmin, self.ymax, self.res * 2**levels, self.crs)
