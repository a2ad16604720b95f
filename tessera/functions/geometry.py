"""Planar geometry as column expressions over polygon rings.

A ring is ``array<struct<x, y>>`` in integer milli-degrees, closed (first vertex
repeated last).  Predicates iterate the ring edges with higher-order functions
(``aggregate``/``exists``), so they run inside whole-stage code generation with
exact integer arithmetic – no Python, no floating-point ties on boundaries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius (km) for point distances, and km per degree of latitude;
# WGS-84 semi-major axis (km) and flattening for the ellipsoidal option.
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = math.pi / 180.0 * EARTH_RADIUS_KM
WGS84_A_KM = 6378.137
WGS84_F = 1 / 298.257223563


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"))


def ring_of(*xy: tuple) -> Column:
    """Ring from (x, y) column pairs; closes it if needed."""
    pts = [point(x, y) for x, y in xy]
    # same objects first and last = already closed (a repeated vertex would only add a
    # zero-length edge, which no predicate counts)
    if not (xy[0][0] is xy[-1][0] and xy[0][1] is xy[-1][1]):
        pts.append(point(*xy[0]))
    return F.array(*pts)


def edges(ring) -> Column:
    """array<struct<a, b>> of consecutive vertex pairs of a closed ring."""
    r = _c(ring)
    return F.transform(F.sequence(F.lit(1), F.size(r) - 1),
                       lambda i: F.struct(F.element_at(r, i).alias("a"), F.element_at(r, i + 1).alias("b")))


def _crosses(e, px, py) -> Column:
    """Edge e crosses the horizontal ray from (px, py) towards +x (integer-exact)."""
    ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
    dy = by - ay
    lhs = (px - ax) * dy
    rhs = (bx - ax) * (py - ay)
    straddles = (ay > py) != (by > py)
    return straddles & F.when(dy > 0, lhs < rhs).otherwise(lhs > rhs)


def _on_edge(e, px, py) -> Column:
    ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
    cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return (cross == 0) & (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx)) \
        & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by))


def inside_even_odd(ring, px, py) -> Column:
    px, py = _c(px), _c(py)
    return F.aggregate(edges(ring), F.lit(False), lambda acc, e: acc != _crosses(e, px, py))


def on_boundary(ring, px, py) -> Column:
    px, py = _c(px), _c(py)
    return F.exists(edges(ring), lambda e: _on_edge(e, px, py))


def st_contains(ring, px, py) -> Column:
    """Polygon strictly contains the point: inside and not on the boundary."""
    return inside_even_odd(ring, px, py) & ~on_boundary(ring, px, py)


def st_anyinteract(ring, px, py) -> Column:
    """Point inside the polygon or on its boundary."""
    return inside_even_odd(ring, px, py) | on_boundary(ring, px, py)


def _left_of(e, x, y) -> Column:
    """The place just above and (far less) to the right of (x, y) lies left of the directed edge: never on it."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    s = dx * (y - e["ay"]) - dy * (x - e["ax"])
    return F.when(s != 0, s > 0).otherwise((dx > 0) | ((dx == 0) & (dy < 0)))


def inside_from_corner(base, cell_edges, px, py, right, bottom) -> Column:
    """Even-odd test inside one grid cell: ``base`` tells whether the polygon holds the cell's lower right corner
    (right, bottom); every edge that the way point -> right side -> corner crosses turns it.  ``cell_edges``
    (array<struct<ax, ay, bx, by>>) holds at least the polygon's edges that touch the cell.  Exact on integers; a point
    on an edge gets either value (see :func:`on_cell_edge`)."""
    px, py, right, bottom = _c(px), _c(py), _c(right), _c(bottom)

    def turned(acc, e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        here = dx * (py - e["ay"]) - dy * (px - e["ax"]) > 0
        side, corner = _left_of(e, right, py), _left_of(e, right, bottom)
        level = ((e["ay"] > py) != (e["by"] > py)) & (here != side)
        down = ((e["ax"] > right) != (e["bx"] > right)) & (side != corner)
        return acc != (level != down)

    return F.aggregate(_c(cell_edges), _c(base), turned)


def on_cell_edge(cell_edges, px, py) -> Column:
    """The point lies on one of the edges of the cell."""
    px, py = _c(px), _c(py)
    return F.exists(_c(cell_edges), lambda e: _on_edge(
        {"a": {"x": e["ax"], "y": e["ay"]}, "b": {"x": e["bx"], "y": e["by"]}}, px, py))


def haversine_km(x1, y1, x2, y2) -> Column:
    """Great-circle km between milli-degree points (x = longitude, y = latitude)."""
    lat1, lat2 = F.radians(_c(y1) / 1000.0), F.radians(_c(y2) / 1000.0)
    dlat = lat2 - lat1
    dlon = F.radians(_c(x2) / 1000.0) - F.radians(_c(x1) / 1000.0)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def _reduced(y) -> Column:
    """Reduced latitude (radians) on WGS-84 of a latitude in milli-degrees."""
    return F.atan((1 - WGS84_F) * F.tan(F.radians(_c(y) / 1000.0)))


def _let(then, **values: Column) -> Column:
    """``then`` of the values, each computed once: inside a lambda nothing else keeps Spark from repeating them."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), then), 1)


def _geodesic_km(b1, l1, b2, l2) -> Column:
    """Andoyer-Lambert distance (km) between reduced latitudes and longitudes (radians)."""
    def from_arc(v):
        sigma = v["sigma"]
        X = (sigma - F.sin(sigma)) * F.pow(F.sin(v["p"]) * F.cos(v["q"]), 2) / F.pow(F.cos(sigma / 2), 2)
        Y = (sigma + F.sin(sigma)) * F.pow(F.cos(v["p"]) * F.sin(v["q"]), 2) / F.pow(F.sin(sigma / 2), 2)
        return F.when(sigma > 0, F.lit(WGS84_A_KM) * (sigma - WGS84_F / 2 * (X + Y))).otherwise(F.lit(0.0))

    cos_s = F.sin(b1) * F.sin(b2) + F.cos(b1) * F.cos(b2) * F.cos(l2 - l1)
    sigma = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos_s)))
    return _let(from_arc, sigma=sigma, p=(b1 + b2) / 2, q=(b2 - b1) / 2)


def andoyer_lambert_km(x1, y1, x2, y2) -> Column:
    """Geodesic distance (km) on the WGS-84 ellipsoid between milli-degree points, by the
    closed-form Andoyer–Lambert first-order correction of the spherical distance (error
    of the order of metres at these ranges).  Coincident points give 0."""
    return _geodesic_km(_reduced(y1), F.radians(_c(x1) / 1000.0), _reduced(y2), F.radians(_c(x2) / 1000.0))


def geodesic_edge_km(edge, px, py) -> Column:
    """Distance (km) on WGS-84 from a point to an edge struct<ax, ay, bx, by>.

    The edge is the arc between its ends on the auxiliary sphere of reduced latitudes, which follows the geodesic to
    first order in the flattening; the foot of the perpendicular on that arc, or the nearer end where the foot lies
    outside, is the closest place, and the distance to it is :func:`andoyer_lambert_km`'s.  As the distance is level
    around its minimum, an error of the foot counts only squared (centimetres at 10 km)."""
    def vector(lon, lat):
        return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)

    def dot(u, v):
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    def cross(u, v):
        return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]

    def named(**vectors):
        return {f"{n}{i}": x for n, v in vectors.items() for i, x in enumerate(v)}

    def part(v, n):
        return tuple(v[f"{n}{i}"] for i in range(3))

    def from_angles(g):
        to_ends = F.least(_geodesic_km(g["ba"], g["la"], g["bp"], g["lp"]), _geodesic_km(g["bb"], g["lb"], g["bp"], g["lp"]))

        def from_normal(v):
            n, p = part(v, "n"), part(v, "p")
            size = dot(n, n)
            off = dot(p, n) / F.when(size > 0, size)
            return _let(from_foot, **named(f=tuple(x - off * y for x, y in zip(p, n)), n=n, a=part(v, "a"), b=part(v, "b")), to_ends=v["to_ends"])

        def from_foot(v):
            foot, n = part(v, "f"), part(v, "n")
            between = (dot(cross(part(v, "a"), foot), n) > 0) & (dot(cross(foot, part(v, "b")), n) > 0)
            lat = F.atan2(foot[2], F.sqrt(foot[0] * foot[0] + foot[1] * foot[1]))
            to_foot = _let(lambda w: _geodesic_km(w["b"], w["l"], g["bp"], g["lp"]), b=lat, l=F.atan2(foot[1], foot[0]))
            return F.when(between, F.least(v["to_ends"], to_foot)).otherwise(v["to_ends"])

        def from_vectors(v):
            a, b = part(v, "a"), part(v, "b")
            return _let(from_normal, **named(n=cross(a, b), a=a, b=b, p=part(v, "p")), to_ends=v["to_ends"])

        return _let(from_vectors, **named(a=vector(g["la"], g["ba"]), b=vector(g["lb"], g["bb"]), p=vector(g["lp"], g["bp"])), to_ends=to_ends)

    return _let(from_angles, la=F.radians(edge["ax"] / 1000.0), ba=_reduced(edge["ay"]), lb=F.radians(edge["bx"] / 1000.0), bb=_reduced(edge["by"]),
                lp=F.radians(_c(px) / 1000.0), bp=_reduced(_c(py)))


def planar_edge_km(edge, px, py) -> Column:
    """Distance (km) from a point to an edge struct<ax, ay, bx, by> in a local equirectangular frame centred on the point."""
    px, py = _c(px), _c(py)
    kx, ky = F.lit(KM_PER_DEGREE) * F.cos(F.radians(py / 1000.0)), F.lit(KM_PER_DEGREE)

    def from_ends(v):
        return _let(from_foot, ax=v["ax"], ay=v["ay"], dx=v["bx"] - v["ax"], dy=v["by"] - v["ay"])

    def from_foot(v):
        ax, ay, dx, dy = v["ax"], v["ay"], v["dx"], v["dy"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / len2))).otherwise(F.lit(0.0))
        return _let(lambda w: F.sqrt(w["cx"] * w["cx"] + w["cy"] * w["cy"]), cx=ax + t * dx, cy=ay + t * dy)

    return _let(from_ends, ax=(edge["ax"] - px) / 1000.0 * kx, ay=(edge["ay"] - py) / 1000.0 * ky,
                bx=(edge["bx"] - px) / 1000.0 * kx, by=(edge["by"] - py) / 1000.0 * ky)


def ring_bbox(ring) -> tuple[Column, Column, Column, Column]:
    r = _c(ring)
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ring_area_km2(ring) -> Column:
    """Shoelace area on the sinusoidal (equal-area) projection of the vertices, km^2."""
    def proj(p):
        lat = F.radians(p["y"] / 1000.0)
        return F.radians(p["x"] / 1000.0) * F.cos(lat) * EARTH_RADIUS_KM, lat * EARTH_RADIUS_KM

    def term(e):
        ax, ay = proj(e["a"])
        bx, by = proj(e["b"])
        return ax * by - bx * ay

    return F.abs(F.aggregate(F.transform(edges(ring), term), F.lit(0.0), lambda acc, v: acc + v) / 2.0)
