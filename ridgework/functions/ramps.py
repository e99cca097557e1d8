"""Named colour ramps."""

from __future__ import annotations

DEFAULT_RAMP = "blue-to-red"

# Ramp names users ask for, with this project's own colour stops (r, g, b).
RAMPS: dict[str, list[tuple[int, int, int]]] = {
    "blue-to-orange": [(30, 80, 200), (140, 180, 230), (245, 235, 200), (250, 170, 80), (230, 100, 10)],
    "green-to-orange": [(40, 130, 60), (160, 200, 110), (250, 240, 160), (250, 180, 80), (235, 110, 20)],
    "blue-to-red": [(20, 60, 190), (110, 150, 230), (235, 235, 235), (230, 120, 100), (190, 20, 30)],
    "green-to-red-orange": [(30, 120, 50), (150, 190, 80), (240, 220, 110), (240, 140, 60), (215, 60, 25)],
    "light-to-dark-sunset": [(255, 240, 200), (255, 200, 140), (240, 130, 110), (180, 70, 120), (80, 30, 90)],
    "light-to-dark-green": [(235, 250, 225), (185, 225, 170), (120, 190, 115), (55, 140, 70), (10, 80, 35)],
    "yellow-to-red-heatmap": [(255, 250, 170), (255, 215, 100), (255, 160, 60), (240, 80, 35), (180, 10, 30)],
    "blue-to-yellow-to-red-heatmap": [(40, 70, 180), (110, 180, 200), (250, 245, 160), (245, 150, 70), (200, 30, 40)],
    "dark-red-to-yellow-heatmap": [(90, 0, 10), (170, 20, 15), (230, 90, 20), (250, 180, 60), (255, 250, 200)],
    "purple-to-dark-purple-to-white-heatmap": [(190, 160, 220), (130, 80, 180), (70, 20, 120), (160, 130, 200), (255, 255, 255)],
    "bold-land-use-qualitative": [(215, 40, 45), (45, 125, 190), (70, 170, 75), (150, 80, 165), (250, 130, 20), (250, 245, 60)],
    "muted-terrain-qualitative": [(205, 190, 160), (165, 185, 145), (125, 155, 140), (175, 165, 185), (220, 210, 195), (145, 140, 130)],
}


def ramp_stops(name: str) -> list[tuple[int, int, int]]:
    """Stops of a ramp; an unknown name falls back to the default ramp."""
    return RAMPS.get(name, RAMPS[DEFAULT_RAMP])
