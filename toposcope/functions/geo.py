"""Geometry as WKB, without a geometry library: points, polygons and their collections."""

from __future__ import annotations

import json
import math
import re
import struct
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.functions import overlay
from toposcope.operators.scratch import written

EARTH_KM = 6371.0088
MERCATOR_M = 6378137.0
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * MERCATOR_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2)


def parse_wkb(raw: bytes) -> tuple[int, object]:
    """(type, coordinates): pairs, lists of pairs, lists of rings; a collection has (type, ...) items."""

    def read(at: int) -> tuple[int, object, int]:
        order = "<" if raw[at] else ">"
        (code,) = struct.unpack_from(order + "I", raw, at + 1)
        at += 5
        if code & 0x20000000:  # an SRID follows
            at, code = at + 4, code & ~0x20000000
        depth = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        kind = code & 0x0FFFFFFF
        if kind > 1000:
            depth, kind = depth + (2 if kind > 3000 else 1), kind % 1000

        def count() -> int:
            nonlocal at
            (n,) = struct.unpack_from(order + "I", raw, at)
            at += 4
            return n

        def line(n: int) -> list:
            nonlocal at
            values = struct.unpack_from(f"{order}{n * depth}d", raw, at)
            at += 8 * n * depth
            return [values[i : i + 2] for i in range(0, len(values), depth)]

        if kind == POINT:
            return kind, line(1)[0], at
        if kind == LINE:
            return kind, line(count()), at
        if kind == POLYGON:
            return kind, [line(count()) for _ in range(count())], at
        parts = []
        for _ in range(count()):
            one, coordinates, at = read(at)
            parts.append((one, coordinates) if kind == COLLECTION else coordinates)
        return kind, parts, at

    kind, coordinates, _ = read(0)
    return kind, coordinates


def write_wkb(kind: int, coordinates) -> bytes:
    head = struct.pack("<BI", 1, kind)
    if kind == POINT:
        return head + struct.pack("<2d", *coordinates)
    if kind == LINE:
        return head + struct.pack("<I", len(coordinates)) + b"".join(struct.pack("<2d", *c) for c in coordinates)
    if kind == POLYGON:
        return head + struct.pack("<I", len(coordinates)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *c) for c in r) for r in coordinates)
    if kind == COLLECTION:
        return head + struct.pack("<I", len(coordinates)) + b"".join(write_wkb(k, c) for k, c in coordinates)
    return head + struct.pack("<I", len(coordinates)) + b"".join(write_wkb(kind - 3, c) for c in coordinates)


def _polygons(kind: int, coordinates) -> list:
    if kind == POLYGON:
        return [coordinates]
    if kind == MULTIPOLYGON:
        return list(coordinates)
    if kind == COLLECTION:
        return [p for k, c in coordinates for p in _polygons(k, c)]
    return []


def _points(kind: int, coordinates) -> list:
    if kind == POINT:
        return [coordinates]
    if kind in (LINE, MULTIPOINT):
        return list(coordinates)
    if kind in (POLYGON, MULTILINE):
        return [p for part in coordinates for p in part]
    if kind == MULTIPOLYGON:
        return [p for polygon in coordinates for ring in polygon for p in ring]
    return [p for k, c in coordinates for p in _points(k, c)]


def inside(x: float, y: float, kind: int, coordinates) -> bool:
    """By ray casting; a point on the right or upper border is outside."""
    for polygon in _polygons(kind, coordinates):
        odd = False
        for ring in polygon:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
        if odd:
            return True
    return False


def _segments(kind: int, coordinates) -> list:
    """Line pieces of lines and of the rings of polygons."""
    if kind == COLLECTION:
        return [x for k, c in coordinates for x in _segments(k, c)]
    lines = [coordinates] if kind == LINE else coordinates if kind in (MULTILINE, POLYGON) else [r for p in coordinates for r in p] if kind == MULTIPOLYGON else []
    return [(tuple(a), tuple(b)) for line in lines for a, b in zip(line, line[1:], strict=False)]


def _on(p: tuple, a: tuple, b: tuple) -> bool:
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    return cross == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def locate(p: tuple, kind: int, coordinates) -> int:
    """1 in the interior, 0 on the border of an area, -1 outside; lines and points are all interior."""
    areas = _polygons(kind, coordinates)
    best = -1
    for polygon in areas:
        if any(_on(p, a, b) for a, b in _segments(POLYGON, polygon)):
            best = max(best, 0)
        elif inside(*p, POLYGON, polygon):
            return 1
    if kind == COLLECTION:
        return max([best, *(locate(p, k, c) for k, c in coordinates if k not in (POLYGON, MULTIPOLYGON))])
    if areas:
        return best
    if kind in (POINT, MULTIPOINT):
        return 1 if any(tuple(c) == tuple(p) for c in _points(kind, coordinates)) else -1
    return 1 if any(_on(p, a, b) for a, b in _segments(kind, coordinates)) else -1


def _cuts(a: tuple, b: tuple, others: list) -> list[float]:
    """Where other pieces meet the piece from a to b, as shares of its length."""
    out = []
    dx, dy = b[0] - a[0], b[1] - a[1]
    for c, d in others:
        ex, ey = d[0] - c[0], d[1] - c[1]
        det = dx * ey - dy * ex
        if det:
            t = ((c[0] - a[0]) * ey - (c[1] - a[1]) * ex) / det
            u = ((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / det
            if 0 <= t <= 1 and 0 <= u <= 1:
                out.append(t)
        else:
            out += [((q[0] - a[0]) * dx + (q[1] - a[1]) * dy) / (dx * dx + dy * dy) for q in (c, d) if (dx or dy) and _on(q, a, b)]
    return out


def within(a: tuple, b: tuple) -> bool:
    """Is all of a in b, and some of it in b's interior?  Both are (kind, coordinates)."""
    spots = [tuple(p) for p in _points(*a)]
    borders = _segments(*b)
    for c, d in _segments(*a):
        cuts = sorted({0.0, 1.0, *_cuts(c, d, borders)})
        spots += [(c[0] + t * (d[0] - c[0]), c[1] + t * (d[1] - c[1])) for t in ((x + y) / 2 for x, y in zip(cuts, cuts[1:], strict=False))]
    at = [locate(p, *b) for p in spots]
    if not at or min(at) < 0:
        return False
    areas = _polygons(*a)
    # a corner of b inside an area of a has points outside b beside it
    if areas and (not _polygons(*b) or any(locate(tuple(p), *a) > 0 for p in _points(*b))):
        return False
    return max(at) > 0 or bool(areas)


def intersects(a: tuple, b: tuple) -> bool:
    if any(locate(tuple(p), *b) >= 0 for p in _points(*a)) or any(locate(tuple(p), *a) >= 0 for p in _points(*b)):
        return True
    others = _segments(*b)
    return any(_cuts(c, d, others) for c, d in _segments(*a))


PREDICATES = {"within": within, "contains": lambda a, b: within(b, a), "intersects": intersects}


#: tests of a point against a piece that are done together
TESTS = 1 << 20


def _ring_pieces(polygon: list) -> np.ndarray:
    """Pieces of all rings, as rows of x1, y1, x2, y2."""
    rings = [np.asarray(ring, float) for ring in polygon]
    return np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings]) if rings else np.zeros((0, 4))


def _odd(x: np.ndarray, y: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Ray casting, as in `inside`, of all points at once."""
    x1, y1, x2, y2 = pieces.T
    cross = (y1 > y[:, None]) != (y2 > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        left = x[:, None] < (x2 - x1) * (y[:, None] - y1) / (y2 - y1) + x1
    return (cross & left).sum(1) % 2 == 1


def _touching(x: np.ndarray, y: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Is a point on a piece?  As in `_on`."""
    x1, y1, x2, y2 = pieces.T
    px, py = x[:, None], y[:, None]
    on = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0
    return (on & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))).any(1)


def locate_all(x: np.ndarray, y: np.ndarray, polygons: list, borders: bool = True) -> np.ndarray:
    """For each point 1 in the interior of a polygon, 0 on a border, -1 outside; without borders the ray alone decides."""
    best = np.full(len(x), -1)
    for polygon in polygons:
        pieces = _ring_pieces(polygon)
        for part in np.array_split(np.arange(len(x)), max(1, len(x) * len(pieces) // TESTS)):
            at = np.where(_odd(x[part], y[part], pieces), 1, -1)
            if borders:
                at[_touching(x[part], y[part], pieces)] = 0
            best[part] = np.maximum(best[part], at)
    return best


_PAIR = struct.Struct("<dd")
_POINT_HEAD = b"\x01\x01\x00\x00\x00"


def _is_point(raw: bytes) -> bool:
    return len(raw) == 21 and raw[:5] == _POINT_HEAD


def _coordinates(points: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    xy = np.frombuffer(b"".join(p[5:] for p in points), "<f8").reshape(-1, 2)
    return xy[:, 0], xy[:, 1]


def related(predicate: str, a: list, b: list) -> list:
    """The predicate of each pair of WKB; null where one is null.

    Points against the same area are tested together, other pairs one by one.
    """
    test = PREDICATES[predicate]
    out: list = [None] * len(a)
    flip = predicate == "contains"
    groups: dict[bytes, list[int]] = {}
    for i, (p, q) in enumerate(zip(*((b, a) if flip else (a, b)), strict=True)):
        if p is not None and q is not None:
            groups.setdefault(q, []).append(i)
    own = b if flip else a
    for raw, rows in groups.items():
        kind, c = parse_wkb(raw)
        points = [i for i in rows if _is_point(own[i])] if kind in (POLYGON, MULTIPOLYGON) else []
        if points:
            at = locate_all(*_coordinates([own[i] for i in points]), _polygons(kind, c))
            for i, where in zip(points, at, strict=True):
                out[i] = bool(where >= 0 if predicate == "intersects" else where > 0)
        for i in rows:
            if out[i] is None:
                other = parse_wkb(own[i])
                out[i] = test((kind, c), other) if flip else test(other, (kind, c))
    return out


def relates(predicate: str):
    """A column function of two WKB columns; null where either is null."""

    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(related(predicate, list(a), list(b)), dtype=object)

    return run


_WKT = re.compile(r"\s*(?:SRID=\d+;)?\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\s*(?:Z|M|ZM)?\s*(\(.*\))\s*$", re.I | re.S)


def from_text(text: str) -> bytes:
    """WKB of well-known text without collections and empty geometries."""
    m = _WKT.match(text)
    if m is None:
        raise ValueError(f"not a geometry: {text[:40]!r}")
    kind = ["", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"].index(m[1].upper())
    pair = lambda x: re.sub(r"\s*([-+.\deE]+)\s+([-+.\deE]+)(?:\s+[-+.\deE]+)*\s*", r"[\1,\2]", x)
    body = json.loads(pair(m[2].replace("(", "[").replace(")", "]")))
    if kind == POINT:
        return write_wkb(kind, tuple(map(float, body[0])))
    if kind == MULTIPOINT:
        body = [c[0] if isinstance(c[0], list) else c for c in body]
    return write_wkb(kind, body)


def register(spark) -> None:
    """SQL names: ST_Point, ST_GeomFromText, ST_Centroid, ST_X, ST_Y, ST_AsGeoJSON, ST_Area, ST_AsWKB, ST_Transform, ST_Union_Agg, ST_Within, ST_Contains, ST_Intersects."""
    from toposcope.functions.projections import st_transform

    @F.pandas_udf(T.BinaryType())
    def geometry_of(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else from_text(t) for t in text], dtype=object)

    @F.pandas_udf(T.BinaryType())
    def middle(geometry: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else write_wkb(POINT, centroid_of(*parse_wkb(g))) for g in geometry], dtype=object)

    def axis(i: int):
        @F.pandas_udf(T.DoubleType())
        def value(geometry: pd.Series) -> pd.Series:
            return pd.Series([None if g is None else float(parse_wkb(g)[1][i]) if parse_wkb(g)[0] == POINT else None for g in geometry], dtype=float)

        return value

    @F.pandas_udf(T.BinaryType())
    def union_all(geometry: pd.Series) -> bytes:
        return merge([g for g in geometry if g is not None])

    names = {"ST_Point": st_point, "ST_GeomFromText": geometry_of, "ST_Centroid": middle, "ST_X": axis(0), "ST_Y": axis(1), "ST_AsGeoJSON": geojson_geometry, "ST_Area": st_area, "ST_Transform": st_transform, "ST_Union_Agg": union_all}
    for name, function in {**names, **{f"ST_{k.capitalize()}": relates(k) for k in PREDICATES}}.items():
        spark.udf.register(name, function)
    # geometries are WKB here
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ST_AsWKB(geometry BINARY) RETURNS BINARY RETURN geometry")


def area_of(kind: int, coordinates) -> float:
    """Of polygons, holes taken off; 0 for all else."""
    total = 0.0
    for polygon in _polygons(kind, coordinates):
        for i, ring in enumerate(polygon):
            r = np.asarray(ring, float) - np.asarray(ring[0], float)
            total += (1 if i == 0 else -1) * abs(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())) / 2
    return total


@F.pandas_udf(T.DoubleType())
def st_area(geometry: pd.Series) -> pd.Series:
    return pd.Series([None if g is None else area_of(*parse_wkb(g)) for g in geometry], dtype=float)


def centroid_of(kind: int, coordinates) -> tuple[float, float]:
    """By area for polygons, by length for lines, else the mean of the points."""
    sx = sy = total = 0.0
    for polygon in _polygons(kind, coordinates):
        for i, ring in enumerate(polygon):
            r = np.asarray(ring, dtype=float)
            x0, y0 = r[0]
            x, y = r[:, 0] - x0, r[:, 1] - y0
            cross = x[:-1] * y[1:] - x[1:] * y[:-1]
            area = abs(cross.sum() / 2)
            sign = 1 if i == 0 else -1
            if area:
                factor = sign * area / cross.sum() / 3
                sx += factor * ((x[:-1] + x[1:]) * cross).sum() + sign * area * x0
                sy += factor * ((y[:-1] + y[1:]) * cross).sum() + sign * area * y0
                total += sign * area
    if not total and kind in (LINE, MULTILINE):
        for line in [coordinates] if kind == LINE else coordinates:
            for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
                d = math.hypot(x2 - x1, y2 - y1)
                sx, sy, total = sx + d * (x1 + x2) / 2, sy + d * (y1 + y2) / 2, total + d
    if not total:
        p = _points(kind, coordinates)
        return sum(c[0] for c in p) / len(p), sum(c[1] for c in p) / len(p)
    return sx / total, sy / total


@F.pandas_udf(T.BinaryType())
def st_point(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([write_wkb(POINT, (a, b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, y, strict=True)], dtype=object)


_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@F.pandas_udf(_XY)
def st_centroid(geometry: pd.Series) -> pd.DataFrame:
    out = []
    for raw in geometry:
        try:
            out.append(centroid_of(*parse_wkb(raw)))
        except (TypeError, ValueError, IndexError, struct.error, ZeroDivisionError):
            out.append((None, None))
    return pd.DataFrame(out, columns=["x", "y"]).astype(float)


@F.pandas_udf(T.BooleanType())
def st_within(x: pd.Series, y: pd.Series, polygon: pd.Series) -> pd.Series:
    """By ray casting: left and lower borders are inside; null where something is null."""
    out = pd.Series([None] * len(x), dtype=object)
    known = x.notna() & y.notna() & polygon.notna()
    for raw, part in x[known].groupby(polygon[known], sort=False):
        at = locate_all(part.to_numpy(float), y[part.index].to_numpy(float), _polygons(*parse_wkb(raw)), borders=False)
        out[part.index] = pd.Series(at > 0, index=part.index, dtype=object)
    return out


@F.pandas_udf(T.StringType())
def geojson_geometry(geometry: pd.Series) -> pd.Series:
    def one(kind: int, coordinates) -> dict:
        if kind == COLLECTION:
            return {"type": NAMES[kind], "geometries": [one(k, c) for k, c in coordinates]}
        return {"type": NAMES[kind], "coordinates": coordinates}

    return pd.Series([json.dumps(one(*parse_wkb(raw))) if raw is not None else None for raw in geometry], dtype=object)


_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])


@F.pandas_udf(_BOX)
def st_box(geometry: pd.Series) -> pd.DataFrame:
    out = []
    for raw in geometry:
        p = _points(*parse_wkb(raw)) if raw is not None else []
        out.append((min(c[0] for c in p), min(c[1] for c in p), max(c[0] for c in p), max(c[1] for c in p)) if p else (None,) * 4)
    return pd.DataFrame(out, columns=["x0", "y0", "x1", "y1"]).astype(float)


def _outermost(polygons: list) -> list:
    """Polygons without those that lie in a rectangle among them: the union is the same with fewer pieces."""
    if len(polygons) < 3:
        return polygons
    rings = [np.asarray([c[:2] for c in p[0]], float) if p and p[0] else np.zeros((1, 2)) for p in polygons]
    boxes = np.array([[*r.min(0), *r.max(0)] for r in rings])
    full = np.array([_fills_box(POLYGON, p) for p in polygons])
    size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    order = np.lexsort((np.arange(len(size)), ~full, -size))
    kept, held = [], np.zeros((0, 4))
    for i in order:
        x0, y0, x1, y1 = boxes[i]
        if not ((held[:, 0] <= x0) & (held[:, 1] <= y0) & (held[:, 2] >= x1) & (held[:, 3] >= y1)).any():
            kept.append(i)
            if full[i]:
                held = np.vstack([held, boxes[i]])
    return [polygons[i] for i in sorted(kept)]


def merge(geometries: list[bytes]) -> bytes | None:
    """Union: distinct points as one multipoint, polygons as what they cover together, lines side by side."""
    geometries = [g for g in geometries if g is not None]
    if not geometries:
        return None
    if all(map(_is_point, geometries)):
        points = sorted({_PAIR.unpack_from(g, 5) for g in geometries})
        packed = [_POINT_HEAD + _PAIR.pack(*p) for p in points]
        return packed[0] if len(packed) == 1 else struct.pack("<BII", 1, MULTIPOINT, len(packed)) + b"".join(packed)
    parsed = [parse_wkb(g) for g in geometries]
    kinds = {k for k, _ in parsed}
    if kinds <= {POINT, MULTIPOINT}:
        points = sorted({tuple(p) for k, c in parsed for p in _points(k, c)})
        return write_wkb(POINT, points[0]) if len(points) == 1 else write_wkb(MULTIPOINT, points)
    parts: dict[bytes, tuple] = {}
    for k, c in parsed:
        for one in [(k - 3, x) for x in c] if MULTIPOINT <= k <= MULTIPOLYGON else c if k == COLLECTION else [(k, c)]:
            parts[write_wkb(*one)] = one
    items = [parts[k] for k in sorted(parts)]
    areas = overlay.union(_outermost([c for k, c in items if k == POLYGON]))
    items = [(k, c) for k, c in items if k != POLYGON] + [(POLYGON, c) for c in areas]
    own = {k for k, _ in items}
    if len(items) == 1:
        return write_wkb(*items[0])
    if len(own) == 1:
        return write_wkb(own.pop() + 3, [c for _, c in items])
    return write_wkb(COLLECTION, items)


@F.pandas_udf(T.BinaryType())
def st_merge(geometries: pd.Series) -> pd.Series:
    return pd.Series([merge(list(g)) if g is not None else None for g in geometries], dtype=object)


#: shapes of one identifier that are merged at once; those of more go in rounds
MERGED = 256
#: shapes of a group of a round, counted by bytes: as many as rectangles have them
TOGETHER = 64
#: geometries that a group has at least on average, however large they are: each round leaves fewer
LEAST = 16
_RECTANGLE_BYTES = 93
#: groups that are handed to Python together
GROUPS_AT_ONCE = 100


def merged(rows: DataFrame, key: str, shape: str, least: int = 1) -> DataFrame:
    """(key, geometry): the union of all shapes of a key that has at least `least` rows.

    Shapes of most keys are merged where they meet.  Those of a hot key, of more than MERGED
    shapes, are merged in rounds, in groups of neighbours: what lies inside of a union is
    gone for the next round, so its borders stay short.  The unions of a round are written.
    """
    spark = rows.sparkSession
    every = rows.select(F.col(key), F.col(shape).alias("geometry")).where(F.col(key).isNotNull())
    known = every.where("geometry is not null")
    hot = written(known.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > MERGED).select(key))
    some = not hot.isEmpty()
    cold = (every.join(hot, key, "left_anti") if some else every).groupBy(key).agg(F.count("*").alias("n"), F.collect_set("geometry").alias("g")).where((F.col("n") >= least) & (F.size("g") > 0))
    done = cold.select(key, st_merge("g").alias("geometry"))
    if not some:
        return done
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= GROUPS_AT_ONCE:
        spark.conf.set(batch, str(GROUPS_AT_ONCE))
    now = written(known.join(hot, key, "left_semi").distinct().withColumn("box", st_box("geometry")))
    middle = lambda v: (F.col(f"box.{v}0") + F.col(f"box.{v}1")) / 2
    weight = F.octet_length("geometry") / _RECTANGLE_BYTES
    while True:
        ends = [f(middle(v)).alias(f"{v}_{n}") for v in "xy" for n, f in (("low", F.min), ("high", F.max))]
        sizes = now.groupBy(key).agg(F.least(F.ceil(F.count("*") / LEAST), F.ceil(F.sum(weight) / TOGETHER)).alias("groups"), *ends)
        sizes = written(sizes.withColumn("side", F.when(F.col("groups") > 1, F.ceil(F.sqrt("groups"))).otherwise(1)))
        last = sizes.where("side > 1").isEmpty()
        tile = lambda v: F.coalesce(F.least(F.floor((middle(v) - F.col(f"{v}_low")) / F.nullif(F.col(f"{v}_high") - F.col(f"{v}_low"), F.lit(0.0)) * F.col("side")), F.col("side") - 1), F.lit(0))
        placed = now.join(sizes, key).withColumn("tx", tile("x")).withColumn("ty", tile("y"))
        # shapes that crowd in one tile go to several groups; in the last round there is one
        crowd = placed.groupBy(key, "tx", "ty").agg(F.least(F.ceil(F.count("*") / LEAST), F.ceil(F.sum(weight) / (4 * TOGETHER))).alias("parts"))
        parts = F.when(F.col("side") > 1, F.greatest("parts", F.lit(1))).otherwise(1)
        groups = placed.join(crowd, [key, "tx", "ty"]).withColumn("part", F.pmod(F.xxhash64("geometry"), parts))
        union = groups.groupBy(key, "tx", "ty", "part").agg(F.collect_list("geometry").alias("g")).select(key, st_merge("g").alias("geometry"))
        if last:
            return done.unionByName(union)
        now = written(written(union).withColumn("box", st_box("geometry")))


#: kinds of extents that a side is sorted into at most, 4 at least; beyond that levels are farther apart
MOST_KINDS = 128


def _level(box: str, v: str) -> Column:
    """The power of 2 that the width or height of a box fits in; null for none.  Cell numbers stay within 2 ** 45."""
    low, high = F.col(f"{box}.{v}0"), F.col(f"{box}.{v}1")
    far = F.greatest(F.abs(low), F.abs(high))
    return F.when(high > low, F.greatest(F.ceil(F.log2(high - low)), F.ceil(F.log2(far)) - 45)).cast("int")


def _levels(df: DataFrame, box: str) -> set[tuple]:
    """Pairs of levels, of width and height, that occur."""
    return {tuple(r) for r in df.select(_level(box, "x"), _level(box, "y")).distinct().collect()}


def _met(kinds: set[tuple], lowest: int, step: int) -> list[tuple[int, int]]:
    """Levels are rounded up to multiples of step; points have the lowest one."""
    return sorted({tuple(-(-(lowest if n is None else n) // step) * step for n in k) for k in kinds})


def _in_cells(df: DataFrame, box: str, others: set[tuple], lowest: int, step: int = 1) -> DataFrame:
    """A row for each cell that a box touches at its own levels, or where these meet a kind of the other side.

    __first has a bit for each of: the cell is the box's first by x, by y; the level is its own by x, by y.
    """
    own = {v: (F.ceil(F.coalesce(_level(box, v), F.lit(lowest)) / step) * step).cast("int") for v in "xy"}
    known = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _met(others, lowest, step)])
    met = F.array_distinct(F.transform(known, lambda o: F.struct(*[F.greatest(o[v], F.col(f"__o{v}")).alias(v) for v in "xy"])))
    rows = df.withColumns({f"__o{v}": own[v] for v in "xy"}).withColumn("__at", F.explode(met))
    rows = rows.withColumns({f"__l{v}": F.col(f"__at.{v}") for v in "xy"}).drop("__at")
    first, last = ({v: F.floor(F.col(f"{box}.{v}{i}") / F.pow(F.lit(2.0), F.col(f"__l{v}"))) for v in "xy"} for i in (0, 1))
    for v in "xy":
        rows = rows.withColumn(f"__c{v}", F.explode(F.sequence(first[v], last[v])))
    bits = [F.col(f"__c{v}") == first[v] for v in "xy"] + [F.col(f"__l{v}") == F.col(f"__o{v}") for v in "xy"]
    return rows.withColumn("__first", sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))).drop("__ox", "__oy")


#: rows of the left side that a task pairs with a cell of the other
CELL_ROWS = 4096


def box_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows of a and b whose boxes, `__a` and `__b`, touch: an equi-join on cells of a hierarchy.

    A box has a level of its width and one of its height, the smallest powers of 2 that
    they fit in, so cells of long thin boxes are long and thin.  It touches four cells there at
    most.  A pair meets at the higher level of the two in either direction, in the cell of the lower
    left corner of what the boxes share; a box is also posted at all such levels that it has with the kinds
    of the other side, of which there are MOST_KINDS at most: with more, powers are taken farther apart.
    A hot cell is dealt out in shares of about CELL_ROWS rows of a, and b goes to each of them.
    """
    ups, downs, step = _levels(a, "__a"), _levels(b, "__b"), 1
    lowest = min((n for k in ups | downs for n in k if n is not None), default=0)
    while max(len(_met(ups, lowest, step)), len(_met(downs, lowest, step))) > MOST_KINDS:
        step *= 2
    cell = ["__lx", "__ly", "__cx", "__cy"]
    left = _in_cells(a, "__a", downs or {(lowest, lowest)}, lowest, step)
    right = _in_cells(b, "__b", ups or {(lowest, lowest)}, lowest, step).withColumnRenamed("__first", "__theirs")
    # counts of full cells only: at most a row for every CELL_ROWS rows of a
    full = written(left.groupBy(*cell).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("__shares")).where("__shares > 1"))
    if not full.isEmpty():
        shares = F.coalesce("__shares", F.lit(1))
        # which share a row is in follows from its box, so that a task that runs again deals alike
        left = left.join(full, cell, "left").withColumn("__share", F.pmod(F.xxhash64("__a"), shares).cast("int")).drop("__shares")
        right = right.join(full, cell, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
        cell = [*cell, "__share"]
    # pairs grow faster than rows: partitions of few bytes stay as they are
    left = left.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)
    # what each pair is asked for is laid out flat
    flat = lambda df, box: df.withColumns({f"{box}_{c}": F.col(f"{box}.{c}") for c in ("x0", "y0", "x1", "y1")}).drop(box)
    near = flat(left, "__a").join(flat(right, "__b"), cell)
    touch = [(F.col(f"__a_{v}0") <= F.col(f"__b_{v}1")) & (F.col(f"__b_{v}0") <= F.col(f"__a_{v}1")) for v in "xy"]
    # the first cell of one by x and of one by y holds the corner; levels of neither are those of other pairs
    once = near.where(touch[0] & touch[1] & (F.col("__first").bitwiseOR(F.col("__theirs")) == 15))
    return once.drop(*cell, "__share", "__first", "__theirs", *[f"__{s}_{c}" for s in "ab" for c in ("x0", "y0", "x1", "y1")])


def spatial_join(points: DataFrame, polygons: DataFrame, how: str = "inner") -> DataFrame:
    """points (x, y) with polygons (geometry) that hold them, left and lower borders included."""
    if how == "left":  # rows are numbered once, and both uses read what is on disk
        points = written(points.withColumn("__row", F.monotonically_increasing_id()))
    place = F.struct(F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"))
    a = points.where("x is not null and y is not null").withColumn("__a", place)
    b = polygons.withColumn("__b", st_box("geometry")).where("__b.x0 is not null")
    found = box_join(a, b).where(st_within("x", "y", "geometry")).drop("__a", "__b")
    if how == "inner":
        return found
    extra = [c for c in polygons.columns if c not in points.columns]
    return points.join(found.select("__row", *extra), "__row", "left").drop("__row")


_SHAPE_BOX = T.StructType([*_BOX.fields, T.StructField("filled", T.BooleanType())])


def _fills_box(kind: int, coordinates) -> bool:
    """Is it one rectangle along the axes, all of its box?"""
    if kind != POLYGON or len(coordinates) != 1 or len(coordinates[0]) != 5:
        return False
    ring = [tuple(c[:2]) for c in coordinates[0]]
    xs, ys = {c[0] for c in ring}, {c[1] for c in ring}
    turns = all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:], strict=False))
    return ring[0] == ring[4] and len(xs) == len(ys) == 2 and len(set(ring)) == 4 and turns


@F.pandas_udf(_SHAPE_BOX)
def st_filled_box(geometry: pd.Series) -> pd.DataFrame:
    """The box, and whether the geometry is all of it."""
    out = []
    for raw in geometry:
        kind, c = parse_wkb(raw) if raw is not None else (None, None)
        p = _points(kind, c) if raw is not None else []
        out.append((min(x[0] for x in p), min(x[1] for x in p), max(x[0] for x in p), max(x[1] for x in p), _fills_box(kind, c)) if p else (None,) * 4 + (False,))
    return pd.DataFrame(out, columns=["x0", "y0", "x1", "y1", "filled"]).astype({c: float for c in ("x0", "y0", "x1", "y1")})


def geometry_join(left: DataFrame, right: DataFrame, predicate: str) -> DataFrame:
    """Rows of left (shape) and right (other) whose geometries relate; the exact test runs on pairs whose boxes touch.

    Rectangles along the axes intersect where their boxes touch: such pairs need no other test.
    """
    a = written(left.withColumn("__a", st_filled_box("shape")).where("__a.x0 is not null"))
    b = written(right.withColumn("__b", st_filled_box("other")).where("__b.x0 is not null"))
    tested = lambda x, y: box_join(x, y).where(relates(predicate)("shape", "other")).drop("__a", "__b")
    if predicate != "intersects":
        return tested(a, b)
    kinds = lambda df, box: {r[0] for r in df.select(f"{box}.filled").distinct().collect()}
    ours, theirs = kinds(a, "__a"), kinds(b, "__b")
    full = lambda df, box, yes: df.where(F.col(f"{box}.filled") if yes else ~F.col(f"{box}.filled"))
    # joins that no pair takes are left out of the plan
    parts = [box_join(full(a, "__a", True), full(b, "__b", True)).drop("__a", "__b")] if True in ours and True in theirs else []
    if True in ours and False in theirs:
        parts.append(tested(full(a, "__a", True), full(b, "__b", False)))
    if False in ours or not parts:
        parts.append(tested(full(a, "__a", False), b))
    return reduce(DataFrame.unionByName, parts)
