"""Geometry as Spark columns: great circles and a planar hexagonal grid.

Cells are axial coordinates written "q,r". The grid is local to the configured origin:
ids are this engine's own, hexagons are regular, and a parent is the coarser cell that
holds a cell's centre.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayspark.config import DEFAULT, Params

SQRT3 = 1.7320508075688772
#: Axial steps to the six neighbours, in turning order.
RING = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column, p: Params = DEFAULT) -> Column:
    """Great-circle distance in km; the arcsine's argument is held to 1."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * p.earth_km) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def steps(points: Column, p: Params = DEFAULT) -> Column:
    """Distances between consecutive points of array<struct<lng,lat>>."""
    n = F.size(points)
    heads, tails = F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: haversine(a["lng"], a["lat"], b["lng"], b["lat"], p))


def path_km(points: Column, p: Params = DEFAULT) -> Column:
    return F.aggregate(steps(points, p), F.lit(0.0), lambda s, x: s + x)


#: Differences below this are ties, which fall alike in any engine.
TIE = 1e-9


def encode_all(points: Column, edge: float, p: Params = DEFAULT) -> Column:
    """The cells of array<struct<lng,lat>>, by rounding cube coordinates. Each step is a
    transform of its own, so that no intermediate value is computed twice."""

    def fraction(pt: Column) -> Column:
        x, y = (pt["lng"] - p.origin_lng) * p.km_per_lng, (pt["lat"] - p.origin_lat) * p.km_per_lat
        return F.struct(((F.lit(SQRT3 / 3) * x - y / 3.0) / edge).alias("q"), ((F.lit(2.0) * y / 3.0) / edge).alias("r"))

    near = lambda v: F.floor(v + 0.5)
    rounded = F.transform(F.transform(points, fraction), lambda f: F.struct(f["q"].alias("q"), f["r"].alias("r"), near(f["q"]).alias("rq"), near(f["r"]).alias("rr"), near(-f["q"] - f["r"]).alias("rs")))
    off = F.transform(rounded, lambda f: F.struct(f["rq"].alias("rq"), f["rr"].alias("rr"), f["rs"].alias("rs"), F.abs(f["rq"] - f["q"]).alias("dq"), F.abs(f["rr"] - f["r"]).alias("dr"), F.abs(f["rs"] + f["q"] + f["r"]).alias("ds")))

    def cell(f: Column) -> Column:
        by_q = (f["dq"] > f["dr"] + TIE) & (f["dq"] > f["ds"] + TIE)
        cq = F.when(by_q, -f["rr"] - f["rs"]).otherwise(f["rq"])
        cr = F.when(~by_q & (f["dr"] > f["ds"] + TIE), -f["rq"] - f["rs"]).otherwise(f["rr"])
        return F.concat(cq.cast("bigint").cast("string"), F.lit(","), cr.cast("bigint").cast("string"))

    return F.transform(off, cell)


def encode(lng: Column, lat: Column, edge: float, p: Params = DEFAULT) -> Column:
    """The cell of one point."""
    return F.get(encode_all(F.array(F.struct(lng.alias("lng"), lat.alias("lat"))), edge, p), F.lit(0))


def q_of(cell: Column) -> Column:
    return F.split(cell, ",")[0].cast("bigint")


def r_of(cell: Column) -> Column:
    return F.split(cell, ",")[1].cast("bigint")


def centre(cell: Column, edge: float, p: Params = DEFAULT) -> Column:
    """struct<lng,lat> of a cell's centre."""
    q, r = q_of(cell), r_of(cell)
    return F.struct(
        (F.lit(p.origin_lng) + F.lit(edge * SQRT3) * (q + r / 2.0) / p.km_per_lng).alias("lng"),
        (F.lit(p.origin_lat) + F.lit(edge * 1.5) * r / p.km_per_lat).alias("lat"),
    )


def parent(cell: Column, edge: float, coarser: float, p: Params = DEFAULT) -> Column:
    c = centre(cell, edge, p)
    return encode(c["lng"], c["lat"], coarser, p)


def boundary(cell: Column, edge: float, p: Params = DEFAULT) -> Column:
    """The six corners, array<struct<lng,lat>>, from the upper right one."""
    c = centre(cell, edge, p)
    angle = lambda i: F.radians(F.lit(60.0) * i + 30.0)
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((c["lng"] + F.cos(angle(i)) * edge / p.km_per_lng).alias("lng"), (c["lat"] + F.sin(angle(i)) * edge / p.km_per_lat).alias("lat")))


def _cell(q: Column, r: Column) -> Column:
    return F.concat(q.cast("string"), F.lit(","), r.cast("string"))


def ring(cell: Column) -> Column:
    """The six neighbours."""
    return F.array(*[_cell(q_of(cell) + dq, r_of(cell) + dr) for dq, dr in RING])


def grid_distance(a: Column, b: Column) -> Column:
    dq, dr = q_of(a) - q_of(b), r_of(a) - r_of(b)
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("bigint")


def grid_path(a: Column, b: Column) -> Column:
    """Cells on the straight line from a to b, both included."""
    n = grid_distance(a, b)

    def at(i: Column) -> Column:
        t = F.when(n == 0, 0.0).otherwise(i / n)
        # nudged off the edges between cells, so that ties fall one way
        q, r = q_of(a) + (q_of(b) - q_of(a)) * t + 1e-6, r_of(a) + (r_of(b) - r_of(a)) * t + 2e-6
        s = -q - r
        rq, rr, rs = (F.floor(v + 0.5) for v in (q, r, s))
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
        by_q = (dq > dr) & (dq > ds)
        return _cell(F.when(by_q, -rr - rs).otherwise(rq).cast("bigint"), F.when(~by_q & (dr > ds), -rq - rs).otherwise(rr).cast("bigint"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), n), at)


def bridge(a: Column, b: Column, most: int = 4) -> Column:
    """Cells strictly between a and b; empty if adjacent, null if too far apart."""
    n, path = grid_distance(a, b), grid_path(a, b)
    return F.when(n > most, F.lit(None)).when(n <= 1, F.array().cast("array<string>")).otherwise(F.slice(path, 2, F.greatest(n - 1, F.lit(1)).cast("int")))
