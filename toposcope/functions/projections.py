"""Map projections and datum shifts over numpy arrays, with columns and WKB on top.

A system is a datum (an ellipsoid, and how its axes lie to those of WGS 84) with a
projection of geographic coordinates, in degrees and in the order longitude, latitude.
Transverse Mercator uses the series in the third flattening to the fourth order, good to
less than a millimetre within a few zones' width; the Swiss projection is the oblique
conformal cylinder over a sphere of the ellipsoid's curvature at Bern.  Heights are taken as
0 on the old ellipsoid, which shifts places by far less than the datum parameters hold.

Known codes: 4326 and 4258 (geographic), 3857, UTM on WGS 84 (326zz north, 327zz south) and on
ETRS 89 (258zz), 2056 and 21781 (Switzerland), 27700 (Great Britain, to about 5 m as the
datum of that grid is not that of a rigid ellipsoid).
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.functions import geo

Pair = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


# fixed values: published axes and flattenings of ellipsoids
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
BESSEL = Ellipsoid(6377397.155, 1 / 299.1528128)
AIRY = Ellipsoid(6377563.396, 1 / 299.3249646)


@dataclass(frozen=True)
class Datum:
    """move: metres along the axes; turn: seconds of arc about them; scale: parts per million; all towards WGS 84."""

    ellipsoid: Ellipsoid
    move: tuple[float, float, float] = (0.0, 0.0, 0.0)
    turn: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: float = 0.0

    def matrix(self) -> np.ndarray:
        """For small angles: the rotation times the scale."""
        rx, ry, rz = (math.radians(t / 3600) for t in self.turn)
        return (1 + self.scale * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])


# fixed values: published shifts to WGS 84
WORLD = Datum(WGS84)
EUROPE = Datum(GRS80)
SWISS = Datum(BESSEL, (674.374, 15.056, 405.346))
BRITISH = Datum(AIRY, (446.448, -125.157, 542.06), (0.1502, 0.247, 0.8421), -20.4894)


def _to_space(lon: np.ndarray, lat: np.ndarray, e: Ellipsoid) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    n = e.a / np.sqrt(1 - e.e2 * np.sin(lat) ** 2)
    return np.stack([n * np.cos(lat) * np.cos(lon), n * np.cos(lat) * np.sin(lon), n * (1 - e.e2) * np.sin(lat)])


def _from_space(xyz: np.ndarray, e: Ellipsoid) -> Pair:
    x, y, z = xyz
    p = np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - e.e2))
    for _ in range(6):  # each step takes an error down to a hundredth
        n = e.a / np.sqrt(1 - e.e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + e.e2 * n * np.sin(lat), p)
    return np.degrees(np.arctan2(y, x)), np.degrees(lat)


def shift(lon: np.ndarray, lat: np.ndarray, old: Datum, new: Datum) -> Pair:
    """Geographic coordinates of one datum in another."""
    if old == new or {old, new} == {WORLD, EUROPE}:  # these two differ by less than they are known to
        return lon, lat
    xyz = old.matrix() @ _to_space(lon, lat, old.ellipsoid) + np.array(old.move)[:, None]
    return _from_space(np.linalg.solve(new.matrix(), xyz - np.array(new.move)[:, None]), new.ellipsoid)


class Geographic:
    def forward(self, lon: np.ndarray, lat: np.ndarray) -> Pair:
        return lon, lat

    inverse = forward


class WebMercator:
    """On a sphere; latitudes of the poles are infinitely far."""

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> Pair:
        with np.errstate(divide="ignore"):
            return np.radians(lon) * WGS84.a, np.log(np.tan(math.pi / 4 + np.radians(lat) / 2)) * WGS84.a

    def inverse(self, x: np.ndarray, y: np.ndarray) -> Pair:
        return np.degrees(x / WGS84.a), np.degrees(2 * np.arctan(np.exp(y / WGS84.a)) - math.pi / 2)


class TransverseMercator:
    def __init__(self, e: Ellipsoid, lon0: float, lat0: float, k0: float, x0: float, y0: float):
        n = e.f / (2 - e.f)
        self.e, self.lon0, self.x0 = math.sqrt(e.e2), lon0, x0
        self.radius = k0 * e.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # fixed values: coefficients of the series, forward and inverse
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        self.y0 = 0.0
        self.y0 = y0 - float(self.forward(np.array([lon0]), np.array([lat0]))[1][0])

    def _conformal(self, t: np.ndarray) -> np.ndarray:
        """Tangent of the conformal latitude, from that of the latitude."""
        s = np.sinh(self.e * np.arctanh(self.e * t / np.hypot(1, t)))
        return t * np.hypot(1, s) - s * np.hypot(1, t)

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> Pair:
        t = self._conformal(np.tan(np.radians(lat)))
        l = np.radians((lon - self.lon0 + 180) % 360 - 180)
        xi, eta = np.arctan2(t, np.cos(l)), np.arcsinh(np.sin(l) / np.hypot(t, np.cos(l)))
        x = eta + sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(self.alpha, 1))
        y = xi + sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(self.alpha, 1))
        return self.x0 + self.radius * x, self.y0 + self.radius * y

    def inverse(self, x: np.ndarray, y: np.ndarray) -> Pair:
        eta, xi = (x - self.x0) / self.radius, (y - self.y0) / self.radius
        eta, xi = (
            eta - sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(self.beta, 1)),
            xi - sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(self.beta, 1)),
        )
        want = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
        t = want
        for _ in range(5):  # Newton's method; the slope is nearly that of the sphere
            own = self._conformal(t)
            slope = (1 - self.e**2) * np.hypot(1, own) * np.hypot(1, t) / (1 + (1 - self.e**2) * t**2)
            t = t + (want - own) / slope
        lon = self.lon0 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi)))
        return (lon + 180) % 360 - 180, np.degrees(np.arctan(t))


class SwissOblique:
    """Ellipsoid to sphere, the sphere turned to its new equator through Bern, then Mercator."""

    def __init__(self, e: Ellipsoid, lon0: float, lat0: float, x0: float, y0: float):
        self.e, self.lon0, self.x0, self.y0 = math.sqrt(e.e2), lon0, x0, y0
        p = math.radians(lat0)
        self.radius = e.a * math.sqrt(1 - e.e2) / (1 - e.e2 * math.sin(p) ** 2)
        self.alpha = math.sqrt(1 + e.e2 / (1 - e.e2) * math.cos(p) ** 4)
        self.b0 = math.asin(math.sin(p) / self.alpha)
        self.k = math.log(math.tan(math.pi / 4 + self.b0 / 2)) - self.alpha * float(self._isometric(np.array([p]))[0])

    def _isometric(self, lat: np.ndarray) -> np.ndarray:
        return np.arctanh(np.sin(lat)) - self.e * np.arctanh(self.e * np.sin(lat))

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> Pair:
        b = np.arcsin(np.tanh(self.alpha * self._isometric(np.radians(lat)) + self.k))
        l = self.alpha * np.radians(lon - self.lon0)
        turned = np.arctan2(np.sin(l), math.sin(self.b0) * np.tan(b) + math.cos(self.b0) * np.cos(l))
        up = math.cos(self.b0) * np.sin(b) - math.sin(self.b0) * np.cos(b) * np.cos(l)
        return self.x0 + self.radius * turned, self.y0 + self.radius * np.arctanh(up)

    def inverse(self, x: np.ndarray, y: np.ndarray) -> Pair:
        l, b = (x - self.x0) / self.radius, np.arcsin(np.tanh((y - self.y0) / self.radius))
        up = math.cos(self.b0) * np.sin(b) + math.sin(self.b0) * np.cos(b) * np.cos(l)
        turned = np.arctan2(np.sin(l), math.cos(self.b0) * np.cos(l) - math.sin(self.b0) * np.tan(b))
        want = (np.arctanh(up) - self.k) / self.alpha
        lat = np.arcsin(np.tanh(want))
        for _ in range(6):
            lat = np.arcsin(np.tanh(want + self.e * np.arctanh(self.e * np.sin(lat))))
        return self.lon0 + np.degrees(turned / self.alpha), np.degrees(lat)


@lru_cache(maxsize=64)
def system(code: str) -> tuple[Datum, object]:
    """Datum and projection of a code such as EPSG:2056."""
    m = re.fullmatch(r"\s*EPSG:(\d{4,5})\s*", code, re.I)
    number = m[1] if m else ""
    plain = {
        "4326": (WORLD, Geographic), "4258": (EUROPE, Geographic), "3857": (WORLD, WebMercator),
        "2056": (SWISS, lambda: SwissOblique(BESSEL, 7 + 26 / 60 + 22.5 / 3600, 46 + 57 / 60 + 8.66 / 3600, 2_600_000.0, 1_200_000.0)),
        "21781": (SWISS, lambda: SwissOblique(BESSEL, 7 + 26 / 60 + 22.5 / 3600, 46 + 57 / 60 + 8.66 / 3600, 600_000.0, 200_000.0)),
        "27700": (BRITISH, lambda: TransverseMercator(AIRY, -2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0)),
    }
    if number in plain:
        datum, projection = plain[number]
        return datum, projection()
    zone = int(number[3:] or 0) if len(number) == 5 and number[:3] in ("326", "327", "258") else 0
    if not (1 <= zone <= 60) or number[:3] == "258" and not 28 <= zone <= 38:
        raise ValueError(f"no projection for {code}")
    datum = EUROPE if number[:3] == "258" else WORLD
    return datum, TransverseMercator(datum.ellipsoid, 6.0 * zone - 183, 0.0, 0.9996, 500_000.0, 10_000_000.0 if number[:3] == "327" else 0.0)


def transformer(old: str, new: str) -> Callable[[np.ndarray, np.ndarray], Pair]:
    """A function from coordinates of one system to those of another; unknown codes raise here."""
    (a, p), (b, q) = system(old), system(new)

    def move(x: np.ndarray, y: np.ndarray) -> Pair:
        if old == new:
            return x, y
        return q.forward(*shift(*p.inverse(x, y), a, b))

    return move


_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def project(x: Column, y: Column, old: str, new: str) -> Column:
    """(x, y) in the new system; null where a coordinate is null."""
    move = transformer(old, new)

    @F.pandas_udf(_XY)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        u, v = move(a.to_numpy(float), b.to_numpy(float))
        return pd.DataFrame({"x": u, "y": v})

    both = x.isNotNull() & y.isNotNull()
    return F.when(both, run(x.cast("double"), y.cast("double")))


_POINT = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])


def _places(kind: int, c, out: list) -> None:
    if kind == geo.COLLECTION:
        for k, part in c:
            _places(k, part, out)
    elif isinstance(c[0] if len(c) else (), (int, float)):
        out.append(c)
    else:
        for part in c:
            _places(0, part, out)


def _replaced(kind: int, c, moved) -> object:
    if kind == geo.COLLECTION:
        return [(k, _replaced(k, part, moved)) for k, part in c]
    if isinstance(c[0] if len(c) else (), (int, float)):
        return next(moved)
    return [_replaced(0, part, moved) for part in c]


def moved_wkb(geometries: list, move: Callable[[np.ndarray, np.ndarray], Pair]) -> list:
    """WKB in the new system, all coordinates of the list at once; nulls stay."""
    if all(g is not None and len(g) == _POINT.itemsize and g[:5] == b"\x01\x01\x00\x00\x00" for g in geometries):
        points = np.frombuffer(b"".join(geometries), _POINT).copy()
        points["x"], points["y"] = move(points["x"].copy(), points["y"].copy())
        raw = points.tobytes()
        return [raw[i : i + _POINT.itemsize] for i in range(0, len(raw), _POINT.itemsize)]
    parsed = [geo.parse_wkb(g) if g is not None else None for g in geometries]
    flat: list = []
    for one in filter(None, parsed):
        _places(*one, flat)
    x, y = move(*np.array(flat, float).reshape(-1, 2).T)
    moved = iter(zip(x.tolist(), y.tolist(), strict=True))
    return [None if one is None else geo.write_wkb(one[0], _replaced(*one, moved)) for one in parsed]


def reproject(df: DataFrame, old: str, new: str, column: str = "geometry") -> DataFrame:
    """df with the WKB of a column in another system."""
    move = transformer(old, new)
    if old == new:
        return df

    @F.pandas_udf(T.BinaryType())
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series(moved_wkb(list(raw), move), dtype=object)

    return df.withColumn(column, run(column))


@F.pandas_udf(T.BinaryType())
def st_transform(raw: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """ST_Transform(geometry, from, to); null if any is null, broken geometries and unknown codes raise."""
    out = pd.Series([None] * len(raw), dtype=object)
    known = raw.notna() & old.notna() & new.notna()
    for (a, b), part in raw[known].groupby([old[known], new[known]], sort=False):
        try:
            out[part.index] = pd.Series(moved_wkb(list(part), transformer(a, b)), index=part.index, dtype=object)
        except struct.error as e:
            raise ValueError(f"a geometry to project from {a} to {b} is broken") from e
    return out
