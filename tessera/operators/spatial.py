"""Spatial joins and aggregates over points and polygon rings (milli-degree integers).

Polygons meet points in an equi-join on grid cells, through an index of their edges, never their rings: a cell that an
edge touches (border) holds the polygon's edges there and whether the polygon holds the cell's lower right corner; a
cell inside the polygon only says so.  A point is decided from the few edges of its own cell, exactly, so what is
shuffled does not depend on the length of a ring.  No side is hinted: the planner and AQE size them, and AQE splits a
hot cell of a shuffled join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..session import materialize

# Default grid cell: 500 milli-degrees (about 55 km) on each side.
CELL_MD = 500


def _cells_between(lo: Column, hi: Column, cell: int) -> Column:
    return F.sequence(F.floor(lo / cell).cast("bigint"), F.floor(hi / cell).cast("bigint"))


def _wrapped_cells(lo: Column, hi: Column, cell: int) -> Column:
    """Cells between two longitudes (milli-degrees), continued across the 180th meridian."""
    over = F.when(hi > 180_000, _cells_between(F.lit(-180_000.0), hi - 360_000, cell))
    under = F.when(lo < -180_000, _cells_between(lo + 360_000, F.lit(180_000.0), cell))
    none = F.expr("cast(array() as array<bigint>)")
    return F.array_distinct(F.concat(_cells_between(lo, hi, cell), F.coalesce(over, none), F.coalesce(under, none)))


# ---- the edge index ---------------------------------------------------------------------

EDGE = "struct<ax:double,ay:double,bx:double,by:double>"


def _edge_rows(polys: DataFrame, ring: str) -> DataFrame:
    """One row per ring edge that is not a point: polygon ``_pid`` and the ends, as they stand in the ring."""
    e = polys.select("_pid", F.explode(G.edges(ring)).alias("e"))
    return e.select("_pid", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")) \
        .where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))


def _edge_cells(edges: DataFrame, cell: int, pad_x: float = 0.0, pad_y: float = 0.0) -> DataFrame:
    """Edges exploded to the cells they touch (left and lower side of a cell belong to it, the right side as well), or
    come within the pads of: row by row, the part of the edge inside the row's band decides the columns."""
    low, high = F.least("ay", "by") - pad_y, F.greatest("ay", "by") + pad_y
    rows = edges.withColumn("_cy", F.explode(_cells_between(low, high, cell)))
    slope = (F.col("bx") - F.col("ax")) / F.when(F.col("by") != F.col("ay"), F.col("by") - F.col("ay"))

    def x_at(y: Column) -> Column:  # a milli-degree more to either side covers the rounding
        inside = F.least(F.greatest(y, F.least("ay", "by").cast("double")), F.greatest("ay", "by").cast("double"))
        return F.col("ax") + (inside - F.col("ay")) * slope

    at_low, at_high = x_at(F.col("_cy") * cell - pad_y), x_at((F.col("_cy") + 1) * cell + pad_y)
    left = F.greatest(F.coalesce(F.least(at_low, at_high) - 1, F.least("ax", "bx")), F.least("ax", "bx").cast("double")) - pad_x
    right = F.least(F.coalesce(F.greatest(at_low, at_high) + 1, F.greatest("ax", "bx")), F.greatest("ax", "bx").cast("double")) + pad_x
    return rows.withColumn("_cx", F.explode(F.sequence((F.ceil(left / cell) - 1).cast("bigint"), F.floor(right / cell).cast("bigint"))))


def _line_crossings(edges: DataFrame, cell: int) -> DataFrame:
    """(_pid, _cy, columns): where the polygon's edges cross the lower line of a grid row (just above it), as the columns
    whose right end is the first one not left of the crossing, in order.  Exact on integers."""
    up = F.col("by") > F.col("ay")
    e = edges.where(F.col("ay") != F.col("by")).select(
        "_pid", *[F.when(up, a).otherwise(F.col(b)).alias(c) for a, b, c in (
            (F.col("ax"), "bx", "x0"), (F.col("ay"), "by", "y0"), (F.col("bx"), "ax", "x1"), (F.col("by"), "ay", "y1"))])
    first, last = F.ceil(F.col("y0") / cell), F.ceil(F.col("y1") / cell) - 1  # lines y0 <= y < y1
    e = e.where(first <= last).withColumn("_cy", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    place = (F.col("x0") * dy + (F.col("_cy") * cell - F.col("y0")) * dx) / (dy * cell)  # in columns
    column = F.ceil(place) - 1 + F.when((place == F.ceil(place)) & (dx > 0), 1).otherwise(0)
    return e.groupBy("_pid", "_cy").agg(F.sort_array(F.collect_list(column.cast("bigint"))).alias("columns"))


def edge_index(polys: DataFrame, ring: str = "ring", cell: int = CELL_MD) -> DataFrame:
    """(_cx, _cy, _pid, _base, _edges) of polygons with an id column ``_pid``: border cells with their edges and whether
    the polygon holds their lower right corner, and inner cells (base true, no edges)."""
    edges = _edge_rows(polys, ring)
    ends = F.struct(*[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    border = _edge_cells(edges, cell).groupBy("_pid", "_cx", "_cy").agg(F.collect_list(ends).alias("_edges"))
    lines = _line_crossings(edges, cell)
    beyond = F.size(F.filter("columns", lambda k: k > F.col("_cx")))
    border = border.join(lines, ["_pid", "_cy"], "left").select(
        "_cx", "_cy", "_pid", F.coalesce(F.pmod(beyond, F.lit(2)) == 1, F.lit(False)).alias("_base"), "_edges")
    runs = F.transform(F.sequence(F.lit(1), F.size("columns") - 1, F.lit(2)),
                       lambda i: F.struct(F.element_at("columns", i).alias("f"), (F.element_at("columns", (i + 1).cast("int")) - 1).alias("t")))
    held = lines.where(F.size("columns") > 1).select("_pid", "_cy", F.explode(runs).alias("run")).where("run.f <= run.t") \
        .select("_pid", "_cy", F.explode(F.sequence("run.f", "run.t")).alias("_cx"))
    inner = held.join(border.select("_pid", "_cx", "_cy"), ["_pid", "_cx", "_cy"], "left_anti") \
        .select("_cx", "_cy", "_pid", F.lit(True).alias("_base"), F.expr(f"cast(array() as array<{EDGE}>)").alias("_edges"))
    return border.unionByName(inner)


def _numbered(polys: DataFrame, ring: str) -> DataFrame:
    """Polygons with a number of their own, written once (repeated rows and ids stay apart)."""
    return materialize(polys.where(F.size(ring) > 1).withColumn("_pid", F.monotonically_increasing_id()), "polygons")


def _holds(base, edges, x, y, cell: int, strict: bool) -> Column:
    inside = G.inside_from_corner(base, edges, F.col(x), F.col(y), (F.col("_cx") + 1) * cell, F.col("_cy") * cell)
    on = G.on_cell_edge(edges, F.col(x), F.col(y))
    return (inside & ~on) if strict else (inside | on)


def point_cells(points: DataFrame, x: str, y: str, cell: int = CELL_MD) -> DataFrame:
    return points.withColumn("_cx", F.floor(F.col(x) / cell).cast("bigint")) \
        .withColumn("_cy", F.floor(F.col(y) / cell).cast("bigint"))


def contains_join(polys: DataFrame, points: DataFrame, x: str = "x_md", y: str = "y_md", ring: str = "ring",
                  strict: bool = True, cell: int = CELL_MD) -> DataFrame:
    """(polygon, point) pairs where the polygon contains the point (strictly, or with its boundary when ``strict`` is
    False), with the columns of both but the ring.  Points without a coordinate are in no polygon."""
    numbered = _numbered(polys, ring)
    pairs = point_cells(points, x, y, cell).join(edge_index(numbered, ring, cell), ["_cx", "_cy"]) \
        .where(_holds("_base", "_edges", x, y, cell, strict)).drop("_cx", "_cy", "_base", "_edges")
    return pairs.join(numbered.drop(ring), "_pid").drop("_pid")


def cell_index(polys: DataFrame, ring: str = "ring", cell: int = CELL_MD) -> DataFrame:
    """(_cx, _cy, _covered, _borders): one row per cell that any polygon touches; ``_covered`` if one holds all of it,
    ``_borders`` the edges and corner flags of those that end in it."""
    border = F.when(F.size("_edges") > 0, F.struct("_base", "_edges"))
    return edge_index(polys, ring, cell).groupBy("_cx", "_cy").agg(
        F.max(F.size("_edges") == 0).alias("_covered"), F.collect_list(border).alias("_borders"))


def _in_any(x: str, y: str, cell: int, strict: bool) -> Column:
    return F.col("_covered") | F.exists("_borders", lambda b: _holds(b["_base"], b["_edges"], x, y, cell, strict))


def outside_all(polys: DataFrame, points: DataFrame, key: str, x: str = "x_md", y: str = "y_md",
                ring: str = "ring", strict: bool = True, cell: int = CELL_MD) -> DataFrame:
    """Points in no polygon (NOT EXISTS): a point meets at most one row, that of its cell."""
    index = cell_index(_numbered(polys, ring), ring, cell)
    met = point_cells(points, x, y, cell).join(index, ["_cx", "_cy"], "left")
    return met.where(~F.coalesce(_in_any(x, y, cell, strict), F.lit(False))).select(*points.columns)


def _lat_pad_md(km: float) -> float:
    return km / G.KM_PER_DEGREE * 1000.0


def _lon_pad_md(km: float, max_abs_lat_md: float) -> float:
    lat = min(abs(max_abs_lat_md) / 1000.0 + _lat_pad_md(km) / 1000.0, 89.9)
    return km / (G.KM_PER_DEGREE * math.cos(math.radians(lat))) * 1000.0


def within_distance_points(a: DataFrame, b: DataFrame, km: float, ax: str, ay: str, bx: str, by: str,
                           cell: int = CELL_MD, ellipsoidal: bool = False) -> DataFrame:
    """Pairs of points within ``km`` (great circle, or WGS-84 geodesic when ``ellipsoidal``).
    Side ``a`` is spread over the cells its search box touches, side ``b`` sits in one
    cell; the exact distance filters the candidates.  The search box is padded by 1 %
    so the ellipsoid's slightly longer degrees cannot drop a pair; a box that crosses the
    180th meridian goes on at the other side."""
    max_lat = a.agg(F.max(F.abs(F.col(ay)))).first()[0] or 0
    px, py = min(1.01 * _lon_pad_md(km, max_lat), 179_999.0), 1.01 * _lat_pad_md(km)
    ac = a.withColumn("_cx", F.explode(_wrapped_cells(F.col(ax) - px, F.col(ax) + px, cell))) \
        .withColumn("_cy", F.explode(_cells_between(F.col(ay) - py, F.col(ay) + py, cell)))
    pairs = point_cells(b, bx, by, cell).join(ac, ["_cx", "_cy"]).drop("_cx", "_cy")
    dist = G.andoyer_lambert_km(ax, ay, bx, by) if ellipsoidal else G.haversine_km(ax, ay, bx, by)
    return pairs.withColumn("distance_km", dist).where(F.col("distance_km") <= km)


def within_distance_polygons(polys: DataFrame, points: DataFrame, km: float, x: str = "x_md", y: str = "y_md",
                             ring: str = "ring", cell: int = CELL_MD, ellipsoidal: bool = False) -> DataFrame:
    """Points within ``km`` of any polygon – i.e. of their union, since the distance to a union is the smallest distance
    to a member – with that smallest distance (0 inside or on one).

    A cell's row holds the edges that come within ``km`` of the cell, so each point meets one row and keeps its columns.
    Edges are straight in a local frame, or geodesics on WGS-84 when ``ellipsoidal``."""
    numbered = _numbered(polys, ring)
    edges = _edge_rows(numbered, ring)
    max_lat = edges.agg(F.max(F.greatest(F.abs("ay"), F.abs("by")))).first()[0] or 0
    slack = 1.01 if ellipsoidal else 1.0  # an ellipsoid's degrees are a little longer or shorter
    near = _edge_cells(edges, cell, slack * _lon_pad_md(km, max_lat), slack * _lat_pad_md(km))
    ends = F.struct("ax", "ay", "bx", "by")
    index = near.groupBy("_cx", "_cy").agg(F.collect_set(ends).alias("_near")) \
        .join(cell_index(numbered, ring, cell), ["_cx", "_cy"], "full")
    met = point_cells(points, x, y, cell).join(index, ["_cx", "_cy"])
    measure = G.geodesic_edge_km if ellipsoidal else G.planar_edge_km
    to_edge = F.array_min(F.transform("_near", lambda e: measure(e, F.col(x), F.col(y))))
    inside = F.coalesce(_in_any(x, y, cell, False), F.lit(False))
    return met.withColumn("distance_km", F.when(inside, F.lit(0.0)).otherwise(to_edge)) \
        .where(F.col("distance_km") <= km).select(*points.columns, "distance_km")


# ---- convex hull ------------------------------------------------------------------------

def _monotone_chain(xs, ys):
    """Convex hull vertices (counter-clockwise, collinear points dropped)."""
    pts = sorted(set(zip(xs, ys)))
    if len(pts) <= 2:
        return pts

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    lower, upper = [], []
    for p in pts:
        while len(lower) >= 2 and cross(lower[-2], lower[-1], p) <= 0:
            lower.pop()
        lower.append(p)
    for p in reversed(pts):
        while len(upper) >= 2 and cross(upper[-2], upper[-1], p) <= 0:
            upper.pop()
        upper.append(p)
    return lower[:-1] + upper[:-1]


def _hull_rows(group: int, xs, ys) -> pd.DataFrame:
    h = _monotone_chain(xs, ys)
    return pd.DataFrame({"g": [group] * len(h), "x": [p[0] for p in h], "y": [p[1] for p in h]}).astype(
        {"g": "int64", "x": "float64", "y": "float64"})


def _partial_hulls(batches):
    """One hull per task, carried from batch to batch: a task holds a batch and a hull."""
    hull, group = [], 0
    for b in batches:
        if len(b):
            group = int(b["g"].iloc[0])
            hull = _monotone_chain([p[0] for p in hull] + b["x"].tolist(), [p[1] for p in hull] + b["y"].tolist())
    yield _hull_rows(group, [p[0] for p in hull], [p[1] for p in hull])


def _merged_hull(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    return _hull_rows(int(key[0]), df["x"].tolist(), df["y"].tolist())


# Groups of partial hulls after each merge step; the last step joins at most 8 hulls.
HULL_STEPS = (512, 64, 8, 1)


def convex_hull(points: DataFrame, x: str, y: str) -> DataFrame:
    """Convex hull as ordered vertices (vertex_index, x, y), counter-clockwise from the
    leftmost (then lowest) point.

    1. Akl–Toussaint: the extreme points in 8 directions (one aggregate) bound an
       octagon; points strictly inside it cannot be hull vertices and are dropped by a
       column filter.
    2. Each partition reduces its survivors to their hull (Arrow batches).
    3. Partial hulls are merged in groups over a few shuffles, 8 to one at each step;
       hull(A ∪ B) = hull(hull(A) ∪ hull(B)).
    """
    p = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    dirs = {"a": F.col("x"), "b": F.col("y"), "c": F.col("x") + F.col("y"), "d": F.col("x") - F.col("y")}
    aggs = []
    for k, e in dirs.items():
        aggs += [F.min_by(F.struct("x", "y"), e).alias(f"min_{k}"), F.max_by(F.struct("x", "y"), e).alias(f"max_{k}")]
    ext = p.agg(*aggs).first()
    if ext is None or ext["min_a"] is None:
        return points.sparkSession.createDataFrame([], "vertex_index bigint, x double, y double")
    octagon = _monotone_chain(*zip(*[(ext[c]["x"], ext[c]["y"]) for c in ext.asDict()]))
    cand = p
    if len(octagon) >= 3:
        # strictly left of every counter-clockwise octagon edge = strictly inside
        inside = None
        for i in range(len(octagon)):
            (ax, ay), (bx, by) = octagon[i], octagon[(i + 1) % len(octagon)]
            left = (F.lit(bx - ax) * (F.col("y") - ay) - F.lit(by - ay) * (F.col("x") - ax)) > 0
            inside = left if inside is None else inside & left
        cand = p.where(~inside)
    part = "g bigint, x double, y double"
    hulls = cand.withColumn("g", F.spark_partition_id().cast("bigint")).select("g", "x", "y").mapInPandas(_partial_hulls, part)
    for n in HULL_STEPS:
        hulls = hulls.withColumn("g", F.pmod("g", F.lit(n))).groupBy("g").applyInPandas(
            _merged_hull, part)
    # one group is left and its rows are in hull order: the vertex number is the place in it
    return hulls.groupBy("g").applyInPandas(_number_vertices, "vertex_index bigint, x double, y double")


def _number_vertices(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    h = _monotone_chain(df["x"].tolist(), df["y"].tolist())
    return pd.DataFrame({"vertex_index": range(len(h)), "x": [p[0] for p in h], "y": [p[1] for p in h]}).astype(
        {"vertex_index": "int64", "x": "float64", "y": "float64"})


# ---- clipping -----------------------------------------------------------------------------

def clip_ring_convex(subject: Sequence[tuple[float, float]], clip: Sequence[tuple[float, float]]):
    """Sutherland–Hodgman: subject ring clipped by a convex counter-clockwise ring."""
    out = list(subject[:-1]) if subject and subject[0] == subject[-1] else list(subject)
    clip = list(clip[:-1]) if clip and clip[0] == clip[-1] else list(clip)
    for i in range(len(clip)):
        if not out:
            break
        a, b = clip[i], clip[(i + 1) % len(clip)]

        def side(p):
            return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

        inp, out = out, []
        for j in range(len(inp)):
            cur, prev = inp[j], inp[j - 1]
            sc, sp = side(cur), side(prev)
            if sc >= 0:
                if sp < 0:
                    t = sp / (sp - sc)
                    out.append((prev[0] + t * (cur[0] - prev[0]), prev[1] + t * (cur[1] - prev[1])))
                out.append(cur)
            elif sp >= 0:
                t = sp / (sp - sc)
                out.append((prev[0] + t * (cur[0] - prev[0]), prev[1] + t * (cur[1] - prev[1])))
    if out:
        out.append(out[0])
    return out


RING_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


@F.pandas_udf(RING_TYPE)
def clip_by_convex(subject: pd.Series, clip: pd.Series) -> pd.Series:
    """Vectorised per-row clip of a ring by a convex ring (both small arrays)."""
    res = []
    for s, c in zip(subject, clip):
        ring = clip_ring_convex([(p["x"], p["y"]) for p in s], [(p["x"], p["y"]) for p in c])
        res.append([{"x": float(px), "y": float(py)} for px, py in ring])
    return pd.Series(res)


def hull_ring(hull: DataFrame) -> DataFrame:
    """Hull vertices (vertex_index, x, y) -> one row holding the closed ring (bounded size)."""
    r = hull.agg(F.array_sort(F.collect_list(F.struct("vertex_index", "x", "y"))).alias("v"))
    pts = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return r.select(F.when(F.size("v") > 0, F.concat(pts, F.array(F.element_at(pts, 1)))).alias("hull"))


# ---- dissolve (shared-edge union outline) ---------------------------------------------------

def ring_edges(polys: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """One row per ring edge: polygon key, edge position, endpoints."""
    e = polys.select(key, F.posexplode(G.edges(ring)).alias("edge_pos", "e"))
    return e.select(key, "edge_pos", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"),
                    F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def dissolve_outline(polys: DataFrame, key: str, ring: str = "ring", cell: int = CELL_MD) -> DataFrame:
    """Outline of the union of polygons that meet along shared edges: every edge is split
    at the vertices lying on it, pieces are normalised (smaller end first) and pieces that
    occur exactly once form the outline (shared pieces cancel).  Vertices meet edges in a
    grid-cell equi-join.  General overlapping overlay is not covered."""
    ed = ring_edges(polys, key, ring).withColumn("_eid", F.struct(key, "edge_pos"))
    verts = ed.select(F.col("ax").alias("vx"), F.col("ay").alias("vy")).distinct()
    vc = point_cells(verts, "vx", "vy", cell)
    ec = ed.withColumn("_cx", F.explode(_cells_between(F.least("ax", "bx"), F.greatest("ax", "bx"), cell))) \
        .withColumn("_cy", F.explode(_cells_between(F.least("ay", "by"), F.greatest("ay", "by"), cell)))
    on = ec.join(vc, ["_cx", "_cy"]).where(
        ((F.col("bx") - F.col("ax")) * (F.col("vy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("vx") - F.col("ax")) == 0)
        & (F.col("vx") >= F.least("ax", "bx")) & (F.col("vx") <= F.greatest("ax", "bx"))
        & (F.col("vy") >= F.least("ay", "by")) & (F.col("vy") <= F.greatest("ay", "by")))
    # parameter along the edge orders the split points (endpoints included, t in [0, 1])
    length2 = (F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2
    t = ((F.col("vx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("vy") - F.col("ay")) * (F.col("by") - F.col("ay"))) / length2
    pts = on.select("_eid", "vx", "vy", t.alias("t")).distinct()
    w = Window.partitionBy("_eid").orderBy("t")
    pieces = pts.select("_eid", "vx", "vy", F.lead("vx").over(w).alias("wx"), F.lead("vy").over(w).alias("wy")) \
        .where(F.col("wx").isNotNull())
    first = (F.col("vx") < F.col("wx")) | ((F.col("vx") == F.col("wx")) & (F.col("vy") <= F.col("wy")))
    norm = pieces.select(F.when(first, F.col("vx")).otherwise(F.col("wx")).alias("x1"),
                         F.when(first, F.col("vy")).otherwise(F.col("wy")).alias("y1"),
                         F.when(first, F.col("wx")).otherwise(F.col("vx")).alias("x2"),
                         F.when(first, F.col("wy")).otherwise(F.col("vy")).alias("y2"))
    return norm.groupBy("x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n")
