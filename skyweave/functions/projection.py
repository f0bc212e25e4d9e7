"""Map projections as column expressions, and grids that lie in them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


@dataclass(frozen=True)
class Geographic:
    """Longitude and latitude in degrees."""

    def forward(self, lon: Column, lat: Column) -> Pair:
        return lon, lat

    def inverse(self, x: Column, y: Column) -> Pair:
        return x, y


@dataclass(frozen=True)
class Sinusoidal:
    """Equal areas on a sphere: x = R lon cos(lat), y = R lat."""

    radius: float = 6371007.181  # fixed value: the sphere of the daily coarse sensor
    meridian: float = 0.0

    def forward(self, lon: Column, lat: Column) -> Pair:
        return self.radius * F.radians(lon - self.meridian) * F.cos(F.radians(lat)), self.radius * F.radians(lat)

    def inverse(self, x: Column, y: Column) -> Pair:
        lat = y / self.radius
        return self.meridian + F.degrees(x / (self.radius * F.cos(lat))), F.degrees(lat)


@dataclass(frozen=True)
class TransverseMercator:
    """On an ellipsoid, by Krueger's series to the fourth power of the third flattening: a few micrometres off within a zone."""

    meridian: float
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0
    a: float = 6378137.0
    f: float = 1 / 298.257223563

    def series(self) -> tuple[float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
        """The radius of the rectified sphere; coefficients to the plane, from it, and from conformal to geographic latitude (fixed values)."""
        n = self.f / (2 - self.f)
        powers = lambda rows: tuple(sum(c * n**k for k, c in row.items()) for row in rows)
        forward = ({1: 1 / 2, 2: -2 / 3, 3: 5 / 16, 4: 41 / 180}, {2: 13 / 48, 3: -3 / 5, 4: 557 / 1440}, {3: 61 / 240, 4: -103 / 140}, {4: 49561 / 161280})
        inverse = ({1: 1 / 2, 2: -2 / 3, 3: 37 / 96, 4: -1 / 360}, {2: 1 / 48, 3: 1 / 15, 4: -437 / 1440}, {3: 17 / 480, 4: -37 / 840}, {4: 4397 / 161280})
        latitude = ({1: 2, 2: -2 / 3, 3: -2, 4: 116 / 45}, {2: 7 / 3, 3: -8 / 5, 4: -227 / 45}, {3: 56 / 15, 4: -136 / 35}, {4: 4279 / 630})
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), powers(forward), powers(inverse), powers(latitude)

    def forward(self, lon: Column, lat: Column) -> Pair:
        radius, forward, _, _ = self.series()
        e = math.sqrt(self.f * (2 - self.f))
        turn, s = F.radians(lon - self.meridian), F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
        north = sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(forward, 1)), xi)
        east = sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(forward, 1)), eta)
        return self.easting + self.scale * radius * east, self.northing + self.scale * radius * north

    def inverse(self, x: Column, y: Column) -> Pair:
        radius, _, inverse, latitude = self.series()
        north, east = (y - self.northing) / (self.scale * radius), (x - self.easting) / (self.scale * radius)
        xi = sum((-c * F.sin(2 * j * north) * F.cosh(2 * j * east) for j, c in enumerate(inverse, 1)), north)
        eta = sum((-c * F.cos(2 * j * north) * F.sinh(2 * j * east) for j, c in enumerate(inverse, 1)), east)
        conformal = F.asin(F.sin(xi) / F.cosh(eta))
        lat = sum((c * F.sin(2 * j * conformal) for j, c in enumerate(latitude, 1)), conformal)
        return self.meridian + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def utm(zone: int, south: bool = False) -> TransverseMercator:
    if isinstance(zone, bool) or not isinstance(zone, int) or not 1 <= zone <= 60:
        raise ValueError(f"zones are 1 to 60: {zone!r}")
    return TransverseMercator(meridian=6.0 * zone - 183.0, northing=10_000_000.0 if south else 0.0)


@dataclass(frozen=True)
class Grid:
    """Cells in a projection: transform (a, b, c, d, e, f) takes column and row to x = a col + b row + c, y = d col + e row + f; centres lie on halves."""

    projection: Geographic | Sinusoidal | TransverseMercator
    transform: tuple[float, float, float, float, float, float]
    width: int
    height: int

    def __post_init__(self) -> None:
        a, b, _, d, e, _ = self.transform
        if a * e - b * d == 0 or self.width < 1 or self.height < 1:
            raise ValueError("a grid needs a transform that can be undone, and cells")

    def centre(self, x: Column, y: Column) -> Pair:
        """Projected place of a cell's centre."""
        a, b, c, d, e, f = self.transform
        return a * (x + 0.5) + b * (y + 0.5) + c, d * (x + 0.5) + e * (y + 0.5) + f

    def place(self, px: Column, py: Column) -> Pair:
        """Column and row of a projected place, as fractions: whole numbers are centres."""
        a, b, c, d, e, f = self.transform
        whole = a * e - b * d
        return (e * (px - c) - b * (py - f)) / whole - 0.5, (a * (py - f) - d * (px - c)) / whole - 0.5

    def seen_from(self, other: Grid) -> Callable[[Column, Column], Pair]:
        """Fractional column and row here of cells (x, y) of another grid; grids of one projection need no detour over the globe."""

        def at(x: Column, y: Column) -> Pair:
            px, py = other.centre(x, y)
            if other.projection != self.projection:
                px, py = self.projection.forward(*other.projection.inverse(px, py))
            return self.place(px, py)

        return at
