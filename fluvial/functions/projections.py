"""Coordinate systems as column expressions: projections there and back, changes of datum, and how systems are described
(EPSG codes, WKT of both versions, the keys of GeoTIFFs)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from math import atan, atanh, cos, e as E, log, pi, radians, sin, sinh, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class System:
    """kind: geographic, tmerc, lcc, albers, merc, stere (polar) or cea. Angles in degrees, lengths in metres; ``unit``:
    metres of a coordinate's unit. shift: to WGS84, as metres, seconds of arc and parts in a million (position vector)."""

    kind: str
    a: float = 6378137.0
    f: float = 1 / 298.257222101
    lon0: float = 0.0
    lat0: float = 0.0
    first: float | None = None
    second: float | None = None
    k: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    unit: float = 1.0
    shift: tuple[float, ...] = ()

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)


# --- latitudes ------------------------------------------------------------------------------------------------------
def _series(angle: Column, terms: list[float]) -> Column:
    """angle and a series of sines of its even multiples."""
    out = angle
    for j, c in enumerate(terms, 1):
        out = out + c * F.sin(2 * j * angle)
    return out


def _polynomials(n: float, rows: list[list[float]]) -> list[float]:
    """Row j holds the factors of n^j, n^(j+1), ..."""
    return [sum(c * n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, 1)]


#: Factors of the series in the third flattening (fixed values): transverse Mercator there and back, and latitudes from
#: conformal and from authalic ones.
THERE = [[1 / 2, -2 / 3, 5 / 16, 41 / 180], [13 / 48, -3 / 5, 557 / 1440], [61 / 240, -103 / 140], [49561 / 161280]]
BACK = [[1 / 2, -2 / 3, 37 / 96, -1 / 360], [1 / 48, 1 / 15, -437 / 1440], [17 / 480, -37 / 840], [4397 / 161280]]
CONFORMAL = [[2, -2 / 3, -2, 116 / 45], [7 / 3, -8 / 5, -227 / 45], [56 / 15, -136 / 35], [4279 / 630]]
AUTHALIC = [[4 / 3, 4 / 45, -16 / 35, -2582 / 14175], [46 / 45, 152 / 945, -11966 / 14175], [3044 / 2835, 3802 / 14175], [6059 / 4725]]


class _Plain:
    """The functions that formulas use, of numbers."""

    sin, cos, sqrt, log, atanh, sinh = map(staticmethod, (sin, cos, sqrt, log, atanh, sinh))


class _Columns:
    sin, cos, sqrt, log, atanh, sinh = map(staticmethod, (F.sin, F.cos, F.sqrt, F.ln, F.atanh, F.sinh))


def _isometric(m, lat, e):
    """Isometric latitude."""
    return m.atanh(m.sin(lat)) - (e * m.atanh(e * m.sin(lat)) if e else 0.0)


def _radius(m, lat, e2):
    """Radius of a parallel, of an axis of one."""
    return m.cos(lat) / m.sqrt(1 - e2 * m.sin(lat) * m.sin(lat))


def _q(m, lat, e2):
    s = m.sin(lat)
    if not e2:
        return 2 * s
    e = sqrt(e2)
    return (1 - e2) * (s / (1 - e2 * s * s) + m.atanh(e * s) / e)


def _from_isometric(psi: Column, s: System) -> Column:
    return _series(2 * F.atan(F.exp(psi)) - pi / 2, _polynomials(s.n, CONFORMAL))


def _from_q(q: Column, s: System) -> Column:
    share = q / _q(_Plain, pi / 2, s.e2)
    return _series(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share))), _polynomials(s.n, AUTHALIC))


# --- projections: constants, there, back ------------------------------------------------------------------------------
def _tmerc(s: System) -> tuple[Callable, Callable]:
    n, e = s.n, sqrt(s.e2)
    scale = s.k * s.a / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    t0 = sinh(_isometric(_Plain, radians(s.lat0), e))
    there, back = _polynomials(n, THERE), _polynomials(n, BACK)
    xi0 = atan(t0)
    origin = xi0 + sum(c * sin(2 * j * xi0) for j, c in enumerate(there, 1))

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        t, d = F.sinh(_isometric(_Columns, lat, e)), lon - radians(s.lon0)
        xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.hypot(t, F.cos(d)))
        x = eta + sum(c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(there, 1))
        y = xi + sum(c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(there, 1))
        return scale * x, scale * (y - origin)

    def inverse(x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = y / scale + origin, x / scale
        u = xi - sum(c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(back, 1))
        v = eta - sum(c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(back, 1))
        chi = F.asin(F.sin(u) / F.cosh(v))
        return F.atan2(F.sinh(v), F.cos(u)) + radians(s.lon0), _series(chi, _polynomials(n, CONFORMAL))

    return forward, inverse


def _cone(s: System) -> tuple[float, float]:
    """Two parallels of a cone; one parallel counts twice."""
    first = s.lat0 if s.first is None else s.first
    return radians(first), radians(first if s.second is None else s.second)


def _lcc(s: System) -> tuple[Callable, Callable]:
    e = sqrt(s.e2)
    one, two = _cone(s)
    psi, m = (lambda x: _isometric(_Plain, x, e)), (lambda x: _radius(_Plain, x, s.e2))
    n = sin(one) if abs(one - two) < 1e-12 else log(m(one) / m(two)) / (psi(two) - psi(one))
    size = s.a * s.k * m(one) / n * E ** (n * psi(one))
    r0 = size * E ** (-n * psi(radians(s.lat0)))

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        r, theta = size * F.exp(-n * _isometric(_Columns, lat, e)), n * (lon - radians(s.lon0))
        return r * F.sin(theta), r0 - r * F.cos(theta)

    def inverse(x: Column, y: Column) -> tuple[Column, Column]:
        sign = 1.0 if n > 0 else -1.0
        r, theta = sign * F.hypot(x, r0 - y), F.atan2(sign * x, sign * (r0 - y))
        return theta / n + radians(s.lon0), _from_isometric(-F.ln(r / size) / n, s)

    return forward, inverse


def _albers(s: System) -> tuple[Callable, Callable]:
    one, two = _cone(s)
    m1, m2, q1, q2 = _radius(_Plain, one, s.e2), _radius(_Plain, two, s.e2), _q(_Plain, one, s.e2), _q(_Plain, two, s.e2)
    n = sin(one) if abs(one - two) < 1e-12 else (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    r0 = s.a * sqrt(c - n * _q(_Plain, radians(s.lat0), s.e2)) / n

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        r, theta = s.a / n * F.sqrt(c - n * _q(_Columns, lat, s.e2)), n * (lon - radians(s.lon0))
        return r * F.sin(theta), r0 - r * F.cos(theta)

    def inverse(x: Column, y: Column) -> tuple[Column, Column]:
        sign = 1.0 if n > 0 else -1.0
        r, theta = F.hypot(x, r0 - y), F.atan2(sign * x, sign * (r0 - y))
        return theta / n + radians(s.lon0), _from_q((c - (r * n / s.a) * (r * n / s.a)) / n, s)

    return forward, inverse


def _merc(s: System) -> tuple[Callable, Callable]:
    e = sqrt(s.e2)
    size = s.a * (s.k if s.first is None else _radius(_Plain, radians(s.first), s.e2))

    def inverse(x: Column, y: Column) -> tuple[Column, Column]:
        return x / size + radians(s.lon0), _from_isometric(y / size, s)

    return (lambda lon, lat: (size * (lon - radians(s.lon0)), size * _isometric(_Columns, lat, e))), inverse


def _stere(s: System) -> tuple[Callable, Callable]:
    """Polar; the pole is that of lat0, or of the latitude of true scale."""
    e = sqrt(s.e2)
    sign = 1.0 if (s.lat0 if s.first is None else s.first) > 0 else -1.0
    if s.first is None or abs(s.first) == 90:
        size = 2 * s.a * s.k / sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    else:
        true = radians(abs(s.first))
        size = s.a * _radius(_Plain, true, s.e2) * E ** _isometric(_Plain, true, e)

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        r, d = size * F.exp(-_isometric(_Columns, sign * lat, e)), lon - radians(s.lon0)
        return r * F.sin(d), -sign * r * F.cos(d)

    def inverse(x: Column, y: Column) -> tuple[Column, Column]:
        r = F.hypot(x, y)
        lat = F.when(r == 0, pi / 2).otherwise(_from_isometric(-F.ln(F.nullif(r, F.lit(0.0)) / size), s))
        return F.atan2(x, -sign * y) + radians(s.lon0), sign * lat

    return forward, inverse


def _cea(s: System) -> tuple[Callable, Callable]:
    k = s.k if s.first is None else _radius(_Plain, radians(s.first), s.e2)
    there = lambda lon, lat: (s.a * k * (lon - radians(s.lon0)), s.a * _q(_Columns, lat, s.e2) / (2 * k))
    return there, lambda x, y: (x / (s.a * k) + radians(s.lon0), _from_q(2 * k * y / s.a, s))


KINDS = {"tmerc": _tmerc, "lcc": _lcc, "albers": _albers, "merc": _merc, "stere": _stere, "cea": _cea}


def project(lon: Column, lat: Column, system: System) -> tuple[Column, Column]:
    """Coordinates of degrees."""
    if system.kind == "geographic":
        return lon, lat
    x, y = KINDS[system.kind](system)[0](F.radians(lon), F.radians(lat))
    return (x + system.fe) / system.unit, (y + system.fn) / system.unit


def unproject(x: Column, y: Column, system: System) -> tuple[Column, Column]:
    """Degrees of coordinates."""
    if system.kind == "geographic":
        return x, y
    lon, lat = KINDS[system.kind](system)[1](x * system.unit - system.fe, y * system.unit - system.fn)
    lon = F.degrees(lon)
    return lon - 360 * F.floor((lon + 180) / 360), F.degrees(lat)


# --- datums ---------------------------------------------------------------------------------------------------------
def _helmert(p: tuple[Column, ...], shift: tuple[float, ...], back: bool) -> tuple[Column, ...]:
    dx, dy, dz, rx, ry, rz, ppm = (*shift, *(0.0,) * 7)[:7]
    rx, ry, rz = (radians(r / 3600) for r in (rx, ry, rz))
    m = 1 + ppm / 1e6
    if back:
        x, y, z = p[0] - dx, p[1] - dy, p[2] - dz
        return (x + rz * y - ry * z) / m, (-rz * x + y + rx * z) / m, (ry * x - rx * y + z) / m
    x, y, z = p
    return m * (x - rz * y + ry * z) + dx, m * (rz * x + y - rx * z) + dy, m * (-ry * x + rx * y + z) + dz


def change_datum(lon: Column, lat: Column, source: System, target: System) -> tuple[Column, Column]:
    """Degrees on another datum, by way of the shifts to WGS84; systems without a shift count as WGS84 itself. Heights are
    left out, so there and back differ by some millimetres."""
    if source.shift == target.shift:
        return lon, lat
    lam, phi = F.radians(lon), F.radians(lat)
    normal = source.a / F.sqrt(1 - source.e2 * F.sin(phi) * F.sin(phi))
    p = (normal * F.cos(phi) * F.cos(lam), normal * F.cos(phi) * F.sin(lam), normal * (1 - source.e2) * F.sin(phi))
    p = _helmert(p, source.shift, False) if source.shift else p
    x, y, z = _helmert(p, target.shift, True) if target.shift else p
    b, second = target.a * (1 - target.f), target.e2 / (1 - target.e2)
    r = F.hypot(x, y)
    u = F.atan2(z * target.a, r * b)  # one step from the reduced latitude is exact to a tenth of a millimetre on the ground
    out = F.atan2(z + second * b * F.pow(F.sin(u), 3), r - target.e2 * target.a * F.pow(F.cos(u), 3))
    return F.degrees(F.atan2(y, x)), F.degrees(out)


def transform(x: Column, y: Column, source: System, target: System) -> tuple[Column, Column]:
    """Coordinates in another system."""
    if source == target:
        return x, y
    return project(*change_datum(*unproject(x, y, source), source, target), target)


def reproject(rows: DataFrame, source: System, target: System) -> DataFrame:
    """Points (x, y) or lines (parts or pts, of x and y) in another system; other columns stay."""
    at = lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", transform(p["x"], p["y"], source, target))])
    if "parts" in rows.columns:
        return rows.withColumn("parts", F.transform("parts", lambda part: F.transform(part, at)))
    if "pts" in rows.columns:
        return rows.withColumn("pts", F.transform("pts", at))
    x, y = transform(F.col("x"), F.col("y"), source, target)
    return rows.withColumns({"x": x, "y": y})


# --- descriptions ---------------------------------------------------------------------------------------------------
WGS84, GRS80 = 1 / 298.257223563, 1 / 298.257222101
#: Systems by their EPSG codes; zones follow from rules (fixed values).
EPSG = {
    4326: System("geographic", f=WGS84), 4269: System("geographic"), 4258: System("geographic"), 4979: System("geographic", f=WGS84),
    3857: System("merc", f=0.0), 3395: System("merc", f=WGS84), 6933: System("cea", f=WGS84, first=30.0), 5070: System("albers", lon0=-96.0, lat0=23.0, first=29.5, second=45.5),
    3413: System("stere", f=WGS84, lon0=-45.0, first=70.0), 3031: System("stere", f=WGS84, first=-71.0), 2154: System("lcc", lon0=3.0, lat0=46.5, first=49.0, second=44.0, fe=700_000.0, fn=6_600_000.0),
}


def of_epsg(code: int | str) -> System:
    """The system of a code (a number, or "EPSG:..."); an unknown one is an error."""
    number = int(str(code).upper().removeprefix("EPSG:"))
    if number in EPSG:
        return EPSG[number]
    block, zone = divmod(number, 100)
    if 1 <= zone <= 60 and block in (269, 258, 326, 327):
        south = block == 327
        return System("tmerc", f=GRS80 if block in (269, 258) else WGS84, lon0=zone * 6.0 - 183, k=0.9996, fe=500_000.0, fn=10_000_000.0 if south else 0.0)
    raise ValueError(f"unknown coordinate system: EPSG {code}")


def _nodes(text: str) -> list:
    """WKT as nested lists: name, then values and nodes."""
    stack: list[list] = [[]]
    for word in re.findall(r'"(?:[^"]|"")*"|[\[\](),]|[^\[\](),"\s]+', text):
        if word in "[(":
            stack.append([stack[-1].pop()])
        elif word in "])":
            done = stack.pop()
            stack[-1].append(done)
        elif word != ",":
            stack[-1].append(word[1:-1] if word.startswith('"') else word)
    return stack[0][0]


def _find(node: list, *names: str) -> list[list]:
    """All nodes of a name below one, nearest first."""
    here = [c for c in node if isinstance(c, list)]
    return [c for c in here if c[0].upper() in names] + [d for c in here for d in _find(c, *names)]


#: Kinds by the names of methods, and fields by the names of parameters, without spaces and signs (fixed by the formats).
METHODS = {
    "transversemercator": "tmerc", "gausskruger": "tmerc", "lambertconformalconic": "lcc", "lambertconformalconic1sp": "lcc", "lambertconformalconic2sp": "lcc", "lambertconicconformal1sp": "lcc", "lambertconicconformal2sp": "lcc",
    "albersconicequalarea": "albers", "albers": "albers", "albersequalarea": "albers", "mercator": "merc", "mercator1sp": "merc", "mercator2sp": "merc", "mercatorvarianta": "merc", "mercatorvariantb": "merc", "mercatorauxiliarysphere": "web",
    "popularvisualisationpseudomercator": "web", "polarstereographic": "stere", "polarstereographicvarianta": "stere", "polarstereographicvariantb": "stere", "stereographicnorthpole": "stere", "stereographicsouthpole": "stere",
    "cylindricalequalarea": "cea", "lambertcylindricalequalarea": "cea",
}
PARAMETERS = {
    "centralmeridian": "lon0", "longitudeofcenter": "lon0", "longitudeoforigin": "lon0", "longitudeofnaturalorigin": "lon0", "longitudeoffalseorigin": "lon0", "straightverticallongitudefrompole": "lon0",
    "latitudeoforigin": "lat0", "latitudeofcenter": "lat0", "latitudeofnaturalorigin": "lat0", "latitudeoffalseorigin": "lat0",
    "standardparallel1": "first", "latitudeof1ststandardparallel": "first", "latitudeofstandardparallel": "first", "standardparallel2": "second", "latitudeof2ndstandardparallel": "second",
    "scalefactor": "k", "scalefactoratnaturalorigin": "k", "falseeasting": "fe", "eastingatfalseorigin": "fe", "falsenorthing": "fn", "northingatfalseorigin": "fn",
}


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def of_wkt(text: str) -> System:
    """The system that WKT (versions 1 and 2, .prj files too) describes; what is not known is an error."""
    node = _nodes(text)
    spheroid = _find(node, "SPHEROID", "ELLIPSOID")
    if not spheroid:
        raise ValueError("no coordinate system in the text")
    a, inverse = float(spheroid[0][2]), float(spheroid[0][3])
    shift = tuple(float(v) for v in _find(node, "TOWGS84")[0][1:]) if _find(node, "TOWGS84") else ()
    made = System("geographic", a, 1 / inverse if inverse else 0.0, shift=shift if any(shift) else ())
    method = _find(node, "PROJECTION", "METHOD")
    if not method:
        return made
    kind = METHODS.get(_plain(method[0][1]))
    if kind is None:
        raise ValueError(f"unknown projection: {method[0][1]}")
    units = [c for c in node if isinstance(c, list) and c[0].upper() in ("UNIT", "LENGTHUNIT")] or [u for axis in _find(node, "AXIS") for u in _find(axis, "LENGTHUNIT", "UNIT")]
    unit = float(units[-1][2]) if units else 1.0
    fields = {}
    for parameter in _find(node, "PARAMETER"):
        name = PARAMETERS.get(_plain(parameter[1]))
        if name:
            own = _find(parameter, "LENGTHUNIT", "UNIT")
            fields[name] = float(parameter[2]) * ((float(own[0][2]) if own else unit) if name in ("fe", "fn") else 1.0)
    if kind == "web":
        return System("merc", a, 0.0, unit=unit, **{k: v for k, v in fields.items() if k in ("lon0", "fe", "fn")})
    if kind == "stere" and "first" not in fields and abs(fields.get("lat0", 90.0)) != 90:
        fields["first"] = fields["lat0"]  # the older form names the latitude of true scale so
    return replace(made, kind=kind, unit=unit, **fields)


#: Keys of GeoTIFFs, and kinds by the number of the coordinate transformation (fixed by the format).
MODEL, GEOGRAPHIC, AXIS, INVERSE, PROJECTED, CONVERSION, UNITS = 1024, 2048, 2057, 2059, 3072, 3075, 3076
CONVERSIONS = {1: "tmerc", 7: "merc", 8: "lcc", 9: "lcc", 11: "albers", 15: "stere", 28: "cea"}
GEO_FIELDS = {3078: "first", 3079: "second", 3080: "lon0", 3081: "lat0", 3082: "fe", 3083: "fn", 3084: "lon0", 3085: "lat0", 3086: "fe", 3087: "fn", 3088: "lon0", 3092: "k", 3095: "lon0"}
LENGTHS = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937}
USER_DEFINED = 32767


def of_geokeys(keys: tuple[int, ...], numbers: tuple[float, ...] = ()) -> System:
    """The system of a GeoTIFF's keys: by its code, or by the parameters that it states."""
    entries = [keys[i : i + 4] for i in range(4, len(keys) - 3, 4)]
    short = {k: v for k, place, _, v in entries if place == 0}
    stated = {k: numbers[v] for k, place, _, v in entries if place == 34736}
    code = short.get(PROJECTED) or (short.get(GEOGRAPHIC) if short.get(MODEL) == 2 else None)
    if code and code != USER_DEFINED:
        return of_epsg(code)
    if short.get(MODEL) == 2 and AXIS in stated:
        return System("geographic", stated[AXIS], 1 / stated[INVERSE] if stated.get(INVERSE) else 0.0)
    kind = CONVERSIONS.get(short.get(CONVERSION, 0))
    if kind is None:
        raise ValueError("no known coordinate system in the file's keys")
    base = of_epsg(short[GEOGRAPHIC]) if short.get(GEOGRAPHIC, USER_DEFINED) != USER_DEFINED else System("geographic", stated.get(AXIS, 6378137.0), 1 / stated[INVERSE] if stated.get(INVERSE) else GRS80)
    unit = LENGTHS.get(short.get(UNITS, 9001), 1.0)
    fields = {GEO_FIELDS[k]: v * (unit if GEO_FIELDS[k] in ("fe", "fn") else 1.0) for k, v in stated.items() if k in GEO_FIELDS}
    return replace(base, kind=kind, unit=unit, **fields)
