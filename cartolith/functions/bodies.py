"""Bodies, their latitudes and longitudes. Angles are radians unless a name says degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .backend import backend

D2R = math.pi / 180
CENTRIC, GRAPHIC = "planetocentric", "planetographic"


@dataclass(frozen=True)
class Body:
    """Equatorial and polar radius in metres."""

    name: str
    a: float
    b: float

    @property
    def sphere(self) -> bool:
        return self.a == self.b

    @property
    def ecc(self) -> float:
        return 0.0 if self.a <= self.b else math.sqrt(1 - self.b * self.b / (self.a * self.a))


def latitude_kind(text: str) -> str:
    low = text.strip().lower()
    if low in ("ocentric", "planetocentric", "centric"):
        return CENTRIC
    if low in ("ographic", "planetographic", "graphic"):
        return GRAPHIC
    raise ValueError(f"unknown latitude type {text!r} (use ocentric or ographic)")


def _stretched(lat, over: float, under: float):
    m = backend(lat)
    return m.where(m.abs(lat) >= math.pi / 2, lat, m.atan2(m.sin(lat) * over, m.cos(lat) * under))


def graphic_at(lat, a, b):
    """Planetographic latitude of a planetocentric one on axes a and b, which may be Columns too."""
    return _stretched(lat, a * a, b * b)


def centric_at(lat, a, b):
    """Planetocentric latitude of a planetographic one on axes a and b."""
    return _stretched(lat, b * b, a * a)


def radius_at(lat, a, b):
    """Distance from the centre to the surface at a planetocentric latitude on axes a and b."""
    m = backend(lat)
    return a * b / m.hypot(b * m.cos(lat), a * m.sin(lat))


def to_graphic(lat, body: Body):
    """Planetographic latitude of a planetocentric one."""
    return lat if body.sphere else graphic_at(lat, body.a, body.b)


def to_centric(lat, body: Body):
    """Planetocentric latitude of a planetographic one."""
    return lat if body.sphere else centric_at(lat, body.a, body.b)


def convert_latitude(lat, body: Body, source: str, target: str):
    if source == target:
        return lat
    return to_graphic(lat, body) if target == GRAPHIC else to_centric(lat, body)


def local_radius(body: Body, lat_degrees: float) -> float:
    """Distance from the centre to the surface at a planetocentric latitude."""
    if body.sphere:
        return body.a
    return float(radius_at(np.float64(lat_degrees * D2R), body.a, body.b))


def wrap_longitude(lon):
    """lon in [-pi, pi); a value that is there already stays as it is, bit by bit."""
    m = backend(lon)
    return m.where(m.both(lon >= -math.pi, lon < math.pi), lon, lon - 2 * math.pi * m.floor((lon + math.pi) / (2 * math.pi)))
