"""Map projections as expression builders.

``Projection.forward(lon, lat)`` takes east longitude and planetocentric latitude in radians and gives (x, y);
``inverse`` goes back. Both take Columns (and then give Columns that are NULL where the projection does not reach) or
numpy arrays (NaN there). Spheres use closed forms; on ellipsoids a fixed number of Newton or fixed-point steps inverts
the latitude, as a higher-order aggregate among Columns, so everything stays inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from ..raster import format_num
from .backend import backend
from .bodies import CENTRIC, D2R, GRAPHIC, Body, convert_latitude, local_radius, to_centric, to_graphic, wrap_longitude

HALF_PI = math.pi / 2
STEPS = 15

#: Names and aliases, without case or underscores.
NAMES = {
    "equirectangular": "equirectangular", "eqc": "equirectangular", "equi": "equirectangular",
    "simplecylindrical": "simplecylindrical", "simplecyl": "simplecylindrical", "simple": "simplecylindrical",
    "geographic": "geographic", "geo": "geographic", "longlat": "geographic", "latlong": "geographic", "lonlat": "geographic",
    "sinusoidal": "sinusoidal", "sinu": "sinusoidal", "sin": "sinusoidal",
    "orthographic": "orthographic", "ortho": "orthographic",
    "polarstereographic": "polarstereographic", "ps": "polarstereographic", "polar": "polarstereographic", "stere": "polarstereographic", "polarstereo": "polarstereographic",
    "mercator": "mercator", "merc": "mercator",
    "transversemercator": "transversemercator", "tmerc": "transversemercator", "tm": "transversemercator",
    "lambertconformal": "lambertconformal", "lcc": "lambertconformal", "lambertconformalconic": "lambertconformal",
    "lambertazimuthal": "lambertazimuthal", "lambertazimuthalequalarea": "lambertazimuthal", "laea": "lambertazimuthal",
}
#: Names in labels.
DISPLAY = {
    "equirectangular": "Equirectangular", "simplecylindrical": "SimpleCylindrical", "geographic": "Geographic", "sinusoidal": "Sinusoidal", "orthographic": "Orthographic",
    "polarstereographic": "PolarStereographic", "mercator": "Mercator", "transversemercator": "TransverseMercator", "lambertconformal": "LambertConformal", "lambertazimuthal": "LambertAzimuthalEqualArea",
}


def canonical_name(name: str) -> str:
    found = NAMES.get(name.strip().lower().replace("_", ""))
    if found is None:
        raise ValueError(f"unknown projection {name!r}")
    return found


@dataclass(frozen=True)
class Params:
    """User and label parameters: degrees, latitudes of ``kind``."""

    name: str
    body: Body
    kind: str = CENTRIC
    clon: float = 0.0
    clat: float = 0.0
    par1: float = 0.0
    par2: float = 0.0
    k0: float = 0.0  # 0: the default
    radius: float = 0.0  # 0: the body's at clat
    lat0: float = 0.0


@dataclass(frozen=True)
class Domain:
    """Where a projection is used by default: degrees, and the least cosine of the distance from (lon0, clat)."""

    lat_min: float = -90.0
    lat_max: float = 90.0
    dlon_max: float = 0.0
    cos_min: float = -2.0
    clat: float = 0.0

    def contains(self, lon, lat, lon0: float):
        """Boolean Column or array: is a point (radians, planetocentric) inside?"""
        m = backend(lon)
        tests = [lat >= (self.lat_min - 1e-9) * D2R, lat <= (self.lat_max + 1e-9) * D2R]
        if self.dlon_max > 0:
            tests.append(m.abs(wrap_longitude(lon - lon0)) <= (self.dlon_max + 1e-9) * D2R)
        if self.cos_min > -2:
            tests.append(math.sin(self.clat) * m.sin(lat) + math.cos(self.clat) * m.cos(lat) * m.cos(wrap_longitude(lon - lon0)) >= self.cos_min)
        return m.both(*tests)


@dataclass(frozen=True)
class Geotiff:
    """A projection in GeoTIFF terms: parameter keys by id."""

    geographic: bool
    ellipsoid: Body
    transform: int = 0
    params: tuple[tuple[int, float], ...] = ()
    local_radius: bool = False


@dataclass(frozen=True)
class Projection:
    params: Params
    kind: str
    lon0: float
    to_plane: Callable = field(repr=False, compare=False)
    to_globe: Callable = field(repr=False, compare=False)
    geotiff: Geotiff
    proj: str
    title: str
    key: tuple
    domain: Domain = Domain()
    period: float = 0.0

    @property
    def name(self) -> str:
        return self.params.name

    @property
    def body(self) -> Body:
        return self.params.body

    @property
    def geographic(self) -> bool:
        return self.geotiff.geographic

    @property
    def display_name(self) -> str:
        return DISPLAY[self.name]

    def same(self, other: Projection) -> bool:
        return self.key == other.key

    def forward(self, lon, lat):
        m = backend(lon)
        phi = to_graphic(lat, self.body) if self.kind == GRAPHIC else lat
        return _finite(m, *self.to_plane(m, wrap_longitude(lon - self.lon0), phi))

    def inverse(self, x, y):
        """Longitude comes as lon0 plus an offset, not wrapped."""
        m = backend(x)
        dlon, phi = self.to_globe(m, x, y)
        lat = to_centric(phi, self.body) if self.kind == GRAPHIC else phi
        return _finite(m, dlon + self.lon0, lat)


def _finite(m, x, y):
    """Both, or neither where one is missing or not finite."""
    good = m.both(m.abs(x) < math.inf, m.abs(y) < math.inf)
    return m.where(good, x, m.none), m.where(good, y, m.none)


def _if(m, good, *values):
    return tuple(m.where(good, v, m.none) for v in values)


def _clamp(m, v, limit: float = 1.0):
    return m.high(-limit, m.low(limit, v))


# Conformal and authalic helpers (Snyder, "Map Projections: A Working Manual", 1987, equations 15-9, 14-15, 7-9, 3-12, 3-16).


def _t(m, phi, e: float):
    t = m.tan(0.5 * (HALF_PI - phi))
    return t if e == 0 else t / m.pow((1 - e * m.sin(phi)) / (1 + e * m.sin(phi)), 0.5 * e)


def _m(phi: float, e: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _phi_of_t(m, t, e: float):
    first = HALF_PI - 2 * m.atan(t)
    if e == 0:
        return first
    return m.iterate(first, lambda phi: HALF_PI - 2 * m.atan(t * m.pow((1 - e * m.sin(phi)) / (1 + e * m.sin(phi)), 0.5 * e)), STEPS)


def _q(m, sin_phi, e: float):
    if e == 0:
        return 2 * sin_phi
    return (1 - e * e) * (sin_phi / (1 - e * e * sin_phi * sin_phi) - m.log((1 - e * sin_phi) / (1 + e * sin_phi)) / (2 * e))


def _phi_of_q(m, q, e: float, at_pole: float):
    first = m.asin(_clamp(m, q / 2))
    if e == 0:
        phi = first
    else:

        def newton(phi):
            s = m.sin(phi)
            c = 1 - e * e * s * s
            return phi + c * c / (2 * m.cos(phi)) * (q / (1 - e * e) - s / c + m.log((1 - e * s) / (1 + e * s)) / (2 * e))

        phi = m.iterate(first, newton, STEPS)
    return m.where(m.abs(m.abs(q) - at_pole) < 1e-12, m.where(q > 0, HALF_PI, -HALF_PI), phi)


def _scalar():
    from .backend import Arrays

    return Arrays


# Formulas: (m, dlon, phi) -> (x, y) and (m, x, y) -> (dlon, phi), closed over their constants.


def _cylindrical(r: float, cos_ts: float, phi0: float):
    def fwd(m, dl, phi):
        return r * cos_ts * dl, r * (phi - phi0)

    def inv(m, x, y):
        phi = y / r + phi0
        return _if(m, m.abs(phi) <= HALF_PI + 1e-12, x / (r * cos_ts), _clamp(m, phi, HALF_PI))

    return fwd, inv


def _degrees(clon: float):
    def fwd(m, dl, phi):
        return clon + dl / D2R, phi / D2R

    def inv(m, x, y):
        return _if(m, m.abs(y) <= 90 + 1e-9, (x - clon) * D2R, _clamp(m, y * D2R, HALF_PI))

    return fwd, inv


def _sinusoidal(r: float):
    def fwd(m, dl, phi):
        return r * dl * m.cos(phi), r * phi

    def inv(m, x, y):
        phi = _clamp(m, y / r, HALF_PI)
        c = m.cos(phi)
        polar = c < 1e-12
        dl = m.where(polar, 0.0, x / (r * m.where(polar, 1.0, c)))
        good = m.both(m.abs(y / r) <= HALF_PI + 1e-12, m.abs(dl) <= math.pi + 1e-9, m.where(polar, m.abs(x), 0.0) <= 1e-6 * r)
        return _if(m, good, dl, phi)

    return fwd, inv


def _orthographic(r: float, phi0: float):
    s0, c0 = math.sin(phi0), math.cos(phi0)

    def fwd(m, dl, phi):
        facing = s0 * m.sin(phi) + c0 * m.cos(phi) * m.cos(dl)
        return _if(m, facing >= -1e-10, r * m.cos(phi) * m.sin(dl), r * (c0 * m.sin(phi) - s0 * m.cos(phi) * m.cos(dl)))

    def inv(m, x, y):
        rho = m.hypot(x, y)
        centre = rho < 1e-12 * r
        safe = m.where(centre, 1.0, rho)
        sin_c = m.low(safe / r, 1.0)
        cos_c = m.cos(m.asin(sin_c))
        phi = m.asin(_clamp(m, cos_c * s0 + y * sin_c * c0 / safe))
        dl = m.atan2(x * sin_c, safe * cos_c * c0 - y * sin_c * s0)
        return _if(m, rho <= r * (1 + 1e-12), m.where(centre, 0.0, dl), m.where(centre, math.atan2(s0, c0), phi))

    return fwd, inv


def _polar_stereographic(a: float, e: float, phi_c: float, k0: float):
    side = -1.0 if phi_c < 0 else 1.0
    true = side * phi_c
    if HALF_PI - true > 1e-10 and abs(_t(_scalar(), true, e)) >= 1e-15:
        scale = a * _m(true, e) / float(_t(_scalar(), true, e))  # true to scale at a latitude
    else:
        scale = 2 * a * k0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))

    def fwd(m, dl, phi):
        rho = scale * _t(m, side * phi, e)
        return _if(m, side * phi > -HALF_PI + 1e-10, side * rho * m.sin(side * dl), -side * rho * m.cos(side * dl))

    def inv(m, x, y):
        rho = m.hypot(x, y)
        turn = m.where(rho > 0, m.atan2(side * x, -side * y), 0.0)
        return side * turn, side * _phi_of_t(m, rho / scale, e)

    return fwd, inv


def _mercator(a: float, e: float, k0: float):
    def fwd(m, dl, phi):
        good = m.abs(phi) < HALF_PI - 1e-10
        return _if(m, good, a * k0 * dl, -a * k0 * m.log(_t(m, m.where(good, phi, 0.0), e)))

    def inv(m, x, y):
        return x / (a * k0), _phi_of_t(m, m.exp(-y / (a * k0)), e)

    return fwd, inv


def _conformal_conic(a: float, e: float, p1: float, p2: float, p0: float):
    if abs(p1 + p2) < 1e-10:
        raise ValueError("lambertconformal: standard parallels must not be symmetric about the equator")
    np_ = _scalar()
    t1 = float(_t(np_, p1, e))
    n = math.sin(p1) if abs(p1 - p2) <= 1e-10 else math.log(_m(p1, e) / _m(p2, e)) / math.log(t1 / float(_t(np_, p2, e)))
    scale = a * _m(p1, e) / (n * t1**n)
    side = 1.0 if n > 0 else -1.0

    def radius(m, phi):
        polar = m.abs(m.abs(phi) - HALF_PI) < 1e-12
        return m.where(polar, m.where(phi * n > 0, 0.0, m.none), scale * m.pow(_t(m, m.where(polar, 0.0, phi), e), n))

    rho0 = 0.0 if abs(abs(p0) - HALF_PI) < 1e-12 and p0 * n > 0 else scale * float(_t(np_, p0, e)) ** n

    def fwd(m, dl, phi):
        rho = radius(m, phi)
        return rho * m.sin(n * dl), rho0 - rho * m.cos(n * dl)

    def inv(m, x, y):
        rho = side * m.hypot(x, rho0 - y)
        tip = rho == 0
        t = m.pow(m.where(tip, scale, rho) / scale, 1 / n)
        turn = m.atan2(side * x, side * (rho0 - y))
        return m.where(tip, 0.0, turn / n), m.where(tip, side * HALF_PI, _phi_of_t(m, t, e))

    return (fwd, inv), n


def _equal_area(a: float, e: float, phi1: float):
    np_ = _scalar()
    qp = float(_q(np_, 1.0, e))
    rq = a * math.sqrt(qp / 2)
    pole = 1 if abs(phi1 - HALF_PI) < 1e-10 else -1 if abs(phi1 + HALF_PI) < 1e-10 else 0
    if pole:

        def fwd(m, dl, phi):
            rho = a * m.sqrt(m.high(qp - pole * _q(m, m.sin(phi), e), 0.0))
            return rho * m.sin(dl), -pole * rho * m.cos(dl)

        def inv(m, x, y):
            square = (x * x + y * y) / (a * a)
            return _if(m, square <= 2 * qp * (1 + 1e-12), m.atan2(x, -pole * y), _phi_of_q(m, pole * (qp - square), e, qp))

        return fwd, inv
    beta1 = math.asin(max(-1.0, min(1.0, float(_q(np_, math.sin(phi1), e)) / qp)))
    s1, c1 = math.sin(beta1), math.cos(beta1)
    d = a * _m(phi1, e) / (rq * c1)

    def fwd(m, dl, phi):
        sb = _clamp(m, _q(m, m.sin(phi), e) / qp)
        cb = m.sqrt(1 - sb * sb)
        den = 1 + s1 * sb + c1 * cb * m.cos(dl)
        b = rq * m.sqrt(2 / m.high(den, 1e-12))
        return _if(m, den >= 1e-12, b * d * cb * m.sin(dl), (b / d) * (c1 * sb - s1 * cb * m.cos(dl)))

    def inv(m, x, y):
        rho = m.hypot(x / d, y * d)
        centre = rho < 1e-12 * a
        safe = m.where(centre, 1.0, rho)
        half = safe / (2 * rq)
        c = 2 * m.asin(m.low(half, 1.0))
        q = qp * (m.cos(c) * s1 + d * y * m.sin(c) * c1 / safe)
        dl = m.atan2(x * m.sin(c), d * safe * c1 * m.cos(c) - d * d * y * s1 * m.sin(c))
        return _if(m, half <= 1 + 1e-12, m.where(centre, 0.0, dl), m.where(centre, phi1, _phi_of_q(m, q, e, qp)))

    return fwd, inv


def _series(n: float) -> tuple[list[float], list[float]]:
    """Krueger's coefficients to the sixth order (Karney, "Transverse Mercator with an accuracy of a few nanometers", 2011, eqs. 35 and 36)."""
    #: Numerators and denominators by rising power of n.
    alpha = (
        ((1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800)),
        ((13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360)),
        ((61, 240), (-103, 140), (15061, 26880), (167603, 181440)),
        ((49561, 161280), (-179, 168), (6601661, 7257600)),
        ((34729, 80640), (-3418889, 1995840)),
        ((212378941, 319334400),),
    )
    beta = (
        ((1, 2), (-2, 3), (37, 96), (-1, 360), (-81, 512), (96199, 604800)),
        ((1, 48), (1, 15), (-437, 1440), (46, 105), (-1118711, 3870720)),
        ((17, 480), (-37, 840), (-209, 4480), (5569, 90720)),
        ((4397, 161280), (-11, 504), (-830251, 7257600)),
        ((4583, 161280), (-108847, 3991680)),
        ((20648693, 638668800),),
    )
    value = lambda rows: [sum(p / q * n ** (j + i + 1) for i, (p, q) in enumerate(row)) for j, row in enumerate(rows)]
    return value(alpha), value(beta)


def _transverse_mercator(a: float, b: float, phi0: float, k0: float):
    flat = (a - b) / a
    e = math.sqrt(flat * (2 - flat))
    n = flat / (2 - flat)
    scale = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha, beta = _series(n)

    def plane(m, dl, phi):
        s = m.sin(phi)
        inner = m.atanh(_clamp(m, s, 1 - 1e-16))
        t = m.sinh(inner if e == 0 else inner - e * m.atanh(e * s))
        xi = m.atan2(t, m.cos(dl))
        ratio = m.sin(dl) / m.sqrt(1 + t * t)
        good = m.both(m.abs(dl) <= HALF_PI, m.abs(ratio) < 1 - 1e-12)
        eta = m.atanh(m.where(good, ratio, 0.0))

        def series(xi, eta):
            x, y = eta, xi
            for j, c in enumerate(alpha, 1):
                x = x + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
                y = y + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
            return scale * x, scale * y

        return _if(m, good, *(m.once(series, xi, eta) if n else (scale * eta, scale * xi)))

    y0 = float(plane(_scalar(), 0.0, phi0)[1])

    def fwd(m, dl, phi):
        x, y = plane(m, dl, phi)
        return x, y - y0

    def inv(m, x, y):
        xi, eta = (y + y0) / scale, x / scale
        xp, ep = xi, eta
        if n:
            for j, c in enumerate(beta, 1):
                xp = xp - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
                ep = ep - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        target = m.sin(xp) / m.hypot(m.sinh(ep), m.cos(xp))

        def newton(tau):
            root = m.sqrt(1 + tau * tau)
            sigma = m.sinh(e * m.atanh(e * tau / root))
            tip = tau * m.sqrt(1 + sigma * sigma) - sigma * root
            return tau + (target - tip) / m.sqrt(1 + tip * tip) * (1 + (1 - e * e) * tau * tau) / ((1 - e * e) * root)

        tau = target if e == 0 else m.iterate(target, newton, 6)
        return m.atan2(m.sinh(ep), m.cos(xp)), m.atan(tau)

    return fwd, inv


def _shape(body: Body) -> str:
    return f"+R={format_num(body.a)}" if body.sphere else f"+a={format_num(body.a)} +b={format_num(body.b)}"


#: GeoTIFF parameter keys and transformation codes.
STD1, STD2, NAT_LON, NAT_LAT, FALSE_E, FALSE_N, ORIGIN_LON, ORIGIN_LAT, ORIGIN_E, ORIGIN_N, CENTRE_LON, CENTRE_LAT, NAT_SCALE, POLE_LON = 3078, 3079, 3080, 3081, 3082, 3083, 3084, 3085, 3086, 3087, 3088, 3089, 3092, 3095
CT = {"transversemercator": 1, "mercator": 7, "lambertconformal": 8, "lambertazimuthal": 10, "polarstereographic": 15, "equirectangular": 17, "orthographic": 21, "sinusoidal": 24}


def build(p: Params) -> Projection:
    """The projection of a set of parameters; raises ValueError for parameters that it can't have."""
    body, kind, e, num = p.body, p.kind, p.body.ecc, format_num
    name = body.name or "Body"
    lon0 = p.clon * D2R

    def graphic(degrees: float) -> float:
        """Planetographic degrees; untouched where nothing changes."""
        return degrees if kind == GRAPHIC or body.sphere else float(convert_latitude(degrees * D2R, body, kind, GRAPHIC)) / D2R

    own = Body(name, body.a, body.b)
    ball = lambda r: Body(name, r, r)
    offsets = ((FALSE_E, 0.0), (FALSE_N, 0.0))
    tail = f"+lon_0={num(p.clon)}"
    end = lambda shape: f"+x_0=0 +y_0=0 {_shape(shape)} +units=m +no_defs"
    g = graphic(p.clat)
    common = {"params": p, "lon0": lon0}

    def made(kind, formulas, geotiff, proj, title, key, **more):
        return Projection(kind=kind, to_plane=formulas[0], to_globe=formulas[1], geotiff=geotiff, proj=proj, title=title, key=(*key, body.a, body.b), **common, **more)

    if p.name in ("equirectangular", "simplecylindrical"):
        clat = 0.0 if p.name == "simplecylindrical" else p.clat
        r, cos_ts = p.radius or local_radius(body, clat), math.cos(clat * D2R)
        if cos_ts < 1e-10:
            raise ValueError("equirectangular: center latitude too close to the pole")
        tiff = Geotiff(False, ball(r), CT["equirectangular"], ((STD1, clat), (CENTRE_LON, p.clon), (CENTRE_LAT, p.lat0), *offsets), r != body.a)
        proj = f"+proj=eqc +lat_ts={num(clat)} +lat_0={num(p.lat0)} {tail} {end(tiff.ellipsoid)}"
        title = "Simple Cylindrical" if p.name == "simplecylindrical" else "Equirectangular"
        return made(kind, _cylindrical(r, cos_ts, p.lat0 * D2R), tiff, proj, f"{title} (clon={num(p.clon)}, clat={num(clat)}, {kind})", ("eqc", r, cos_ts, p.lat0, p.clon, kind), period=2 * math.pi * r * cos_ts)
    if p.name == "geographic":
        shape = ball(body.a) if kind == CENTRIC else own
        return made(kind, _degrees(p.clon), Geotiff(True, shape), f"+proj=longlat {_shape(shape)} +no_defs", f"Geographic lon/lat degrees ({kind})", ("geo", p.clon, kind), period=360.0)
    if p.name == "sinusoidal":
        tiff = Geotiff(False, ball(body.a), CT[p.name], ((CENTRE_LON, p.clon), *offsets))
        return made(kind, _sinusoidal(body.a), tiff, f"+proj=sinu {tail} {end(tiff.ellipsoid)}", f"Sinusoidal (clon={num(p.clon)}, {kind})", ("sinu", p.clon, kind))
    if p.name == "orthographic":
        tiff = Geotiff(False, ball(body.a), CT[p.name], ((CENTRE_LAT, g), (CENTRE_LON, p.clon), *offsets))
        near = Domain(cos_min=0.0, clat=float(to_centric(g * D2R, body)))
        return made(GRAPHIC, _orthographic(body.a, g * D2R), tiff, f"+proj=ortho +lat_0={num(g)} {tail} {end(tiff.ellipsoid)}", f"Orthographic (clon={num(p.clon)}, clat={num(p.clat)})", ("ortho", g * D2R, p.clon), domain=near)
    if p.name == "polarstereographic":
        if p.clat == 0:
            raise ValueError("polarstereographic: center latitude must be non-zero (use 90 or -90)")
        k0, pole = p.k0 or 1.0, -90.0 if g < 0 else 90.0
        tiff = Geotiff(False, own, CT[p.name], ((NAT_LAT, g), (POLE_LON, p.clon), (NAT_SCALE, k0), *offsets))
        at = f"{tail} +k={num(k0)}" if abs(abs(g) - 90) < 1e-9 else f"+lat_ts={num(g)} {tail}"
        return made(GRAPHIC, _polar_stereographic(body.a, e, g * D2R, k0), tiff, f"+proj=stere +lat_0={num(pole)} {at} {end(body)}", f"Polar Stereographic (clon={num(p.clon)}, clat={num(p.clat)})", ("ps", g * D2R, p.clon, k0), domain=Domain(lat_max=0.0) if g < 0 else Domain(lat_min=0.0))
    if p.name == "mercator":
        k0 = _m(g * D2R, e) * (p.k0 or 1.0)
        tiff = Geotiff(False, own, CT[p.name], ((NAT_LON, p.clon), (NAT_LAT, 0.0), (NAT_SCALE, k0), *offsets))
        return made(GRAPHIC, _mercator(body.a, e, k0), tiff, f"+proj=merc {tail} +k={num(k0)} {end(body)}", f"Mercator (clon={num(p.clon)}, true scale lat={num(p.clat)})", ("merc", k0, p.clon), domain=Domain(lat_min=-85.0, lat_max=85.0), period=2 * math.pi * body.a * k0)
    if p.name == "transversemercator":
        k0 = p.k0 or 1.0
        tiff = Geotiff(False, own, CT[p.name], ((NAT_LON, p.clon), (NAT_LAT, g), (NAT_SCALE, k0), *offsets))
        return made(GRAPHIC, _transverse_mercator(body.a, body.b, g * D2R, k0), tiff, f"+proj=tmerc +lat_0={num(g)} {tail} +k={num(k0)} {end(body)}", f"Transverse Mercator (clon={num(p.clon)}, clat={num(p.clat)}, k={num(k0)})", ("tm", g * D2R, p.clon, k0), domain=Domain(dlon_max=30.0))
    if p.name == "lambertconformal":
        g1, g2 = graphic(p.par1), graphic(p.par2)
        formulas, n = _conformal_conic(body.a, e, g1 * D2R, g2 * D2R, g * D2R)
        tiff = Geotiff(False, own, CT[p.name], ((STD1, g1), (STD2, g2), (ORIGIN_LAT, g), (ORIGIN_LON, p.clon), (ORIGIN_E, 0.0), (ORIGIN_N, 0.0)))
        domain = Domain(lat_min=-30.0, dlon_max=90.0) if n > 0 else Domain(lat_max=30.0, dlon_max=90.0)
        return made(GRAPHIC, formulas, tiff, f"+proj=lcc +lat_1={num(g1)} +lat_2={num(g2)} +lat_0={num(g)} {tail} {end(body)}", f"Lambert Conformal (par1={num(p.par1)}, par2={num(p.par2)}, clat={num(p.clat)}, clon={num(p.clon)})", ("lcc", g1 * D2R, g2 * D2R, g * D2R, p.clon), domain=domain)
    if p.name == "lambertazimuthal":
        tiff = Geotiff(False, own, CT[p.name], ((CENTRE_LAT, g), (CENTRE_LON, p.clon), *offsets))
        near = Domain(cos_min=0.0, clat=float(to_centric(g * D2R, body)))
        return made(GRAPHIC, _equal_area(body.a, e, g * D2R), tiff, f"+proj=laea +lat_0={num(g)} {tail} {end(body)}", f"Lambert Azimuthal Equal Area (clon={num(p.clon)}, clat={num(p.clat)})", ("laea", g * D2R, p.clon), domain=near)
    raise ValueError(f"unsupported projection {p.name!r}")
