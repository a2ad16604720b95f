"""Registered spatial queries: provinces (polygons), cities and earthquakes (points)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial as S
from ..sources.fixtures import ANCHOR_CITY_ID, ANCHOR_PROVINCE_ID, CLIP_PROVINCE, COAST_PROVINCES, fixture
from .oracle import fx, with_ctes
from .registry import register

SIDE, NOTCH = 800, 400
COAST = ", ".join(f"'{n}'" for n in COAST_PROVINCES)
KPD = f"CAST('{G.KM_PER_DEGREE!r}' AS DOUBLE)"


def provinces(spark, sf_dir):
    """Province rings: even ids a square cell, odd ids the cell without its NE quadrant (L)."""
    p = fixture(spark, sf_dir, "provinces_bbox")
    x0, y0 = F.col("x0"), F.col("y0")
    rect = G.ring_of((x0, y0), (x0 + SIDE, y0), (x0 + SIDE, y0 + SIDE), (x0, y0 + SIDE), (x0, y0))
    ell = G.ring_of((x0, y0), (x0 + SIDE, y0), (x0 + SIDE, y0 + NOTCH), (x0 + NOTCH, y0 + NOTCH),
                    (x0 + NOTCH, y0 + SIDE), (x0, y0 + SIDE), (x0, y0))
    return p.select("id", "name", F.when(F.col("id") % 2 == 0, rect).otherwise(ell).alias("ring"))


def quakes(spark, sf_dir):
    return fixture(spark, sf_dir, "quakes")


def cities(spark, sf_dir):
    return fixture(spark, sf_dir, "cities")


SPATIAL_CTES = fx("provinces_bbox", "quakes", "cities") + [
    ("prov", f"""
SELECT id, name, x0, y0, x0 + {SIDE} AS x1, y0 + {SIDE} AS y1, id % 2 = 1 AS notched,
       CASE WHEN id % 2 = 0
            THEN [{{'x': x0, 'y': y0}}, {{'x': x0 + {SIDE}, 'y': y0}}, {{'x': x0 + {SIDE}, 'y': y0 + {SIDE}}},
                  {{'x': x0, 'y': y0 + {SIDE}}}, {{'x': x0, 'y': y0}}]
            ELSE [{{'x': x0, 'y': y0}}, {{'x': x0 + {SIDE}, 'y': y0}}, {{'x': x0 + {SIDE}, 'y': y0 + {NOTCH}}},
                  {{'x': x0 + {NOTCH}, 'y': y0 + {NOTCH}}}, {{'x': x0 + {NOTCH}, 'y': y0 + {SIDE}}},
                  {{'x': x0, 'y': y0 + {SIDE}}}, {{'x': x0, 'y': y0}}] END AS ring
FROM provinces_bbox"""),
    ("edges", """
SELECT p.id, p.name, p.ring[i].x AS a_x, p.ring[i].y AS a_y, p.ring[i + 1].x AS b_x, p.ring[i + 1].y AS b_y
FROM prov p, generate_series(1, len(p.ring) - 1) AS g(i)"""),
]


def inside_sql(p: str, x: str, y: str, strict: bool) -> str:
    """Containment for the square / L provinces written as inequalities (independent of
    the ray casting used on the Spark side)."""
    if strict:
        return (f"({x} > {p}.x0 AND {x} < {p}.x1 AND {y} > {p}.y0 AND {y} < {p}.y1 "
                f"AND NOT ({p}.notched AND {x} >= {p}.x0 + {NOTCH} AND {y} >= {p}.y0 + {NOTCH}))")
    return (f"({x} BETWEEN {p}.x0 AND {p}.x1 AND {y} BETWEEN {p}.y0 AND {p}.y1 "
            f"AND NOT ({p}.notched AND {x} > {p}.x0 + {NOTCH} AND {y} > {p}.y0 + {NOTCH}))")


def ssql(body: str, extra=None) -> str:
    return with_ctes(SPATIAL_CTES + list(extra or []), body)


@register("st_contains", ssql(f"""
SELECT p.id AS province_id, q.id AS quake_id FROM prov p JOIN quakes q ON {inside_sql('p', 'q.x_md', 'q.y_md', True)}"""))
def q_st_contains(spark, sf_dir):
    return S.contains_join(provinces(spark, sf_dir).withColumnRenamed("id", "province_id"),
                           quakes(spark, sf_dir).withColumnRenamed("id", "quake_id")).select("province_id", "quake_id")


@register("st_anyinteract", ssql(f"""
SELECT p.id AS province_id, q.id AS quake_id FROM prov p JOIN quakes q ON {inside_sql('p', 'q.x_md', 'q.y_md', False)}"""))
def q_st_anyinteract(spark, sf_dir):
    return S.contains_join(provinces(spark, sf_dir).withColumnRenamed("id", "province_id"),
                           quakes(spark, sf_dir).withColumnRenamed("id", "quake_id"), strict=False) \
        .select("province_id", "quake_id")


@register("spatial_join_contains", ssql(f"""
SELECT p.id AS province_id, p.name, c.id AS city_id, c.nombre AS name_city
FROM prov p JOIN cities c ON {inside_sql('p', 'c.x_md', 'c.y_md', True)}"""))
def q_spatial_join_contains(spark, sf_dir):
    j = S.contains_join(provinces(spark, sf_dir).withColumnRenamed("id", "province_id"),
                        cities(spark, sf_dir).withColumnRenamed("id", "city_id"))
    return j.select("province_id", "name", "city_id", F.col("nombre").alias("name_city"))


@register("cities_in_province", ssql(f"""
SELECT p.name, p.id, c.nombre AS name_city, c.x_md, c.y_md
FROM prov p JOIN cities c ON {inside_sql('p', 'c.x_md', 'c.y_md', True)} WHERE p.id = {ANCHOR_PROVINCE_ID}"""))
def q_cities_in_province(spark, sf_dir):
    p = provinces(spark, sf_dir).where(F.col("id") == ANCHOR_PROVINCE_ID)
    j = S.contains_join(p, cities(spark, sf_dir).withColumnRenamed("id", "city_id"))
    return j.select("name", "id", F.col("nombre").alias("name_city"), "x_md", "y_md")


@register("city_count", ssql(f"""
SELECT p.name, CAST(COUNT(*) AS BIGINT) AS city_count
FROM prov p JOIN cities c ON {inside_sql('p', 'c.x_md', 'c.y_md', True)} GROUP BY p.name"""))
def q_city_count(spark, sf_dir):
    j = S.contains_join(provinces(spark, sf_dir), cities(spark, sf_dir).withColumnRenamed("id", "city_id"))
    return j.groupBy("name").agg(F.count(F.lit(1)).cast("bigint").alias("city_count"))


@register("quakes_in_province", ssql(f"""
SELECT p.name, p.id, q.id AS quake_id, q.x_md, q.y_md
FROM prov p JOIN quakes q ON {inside_sql('p', 'q.x_md', 'q.y_md', True)} WHERE p.id = {ANCHOR_PROVINCE_ID}"""))
def q_quakes_in_province(spark, sf_dir):
    p = provinces(spark, sf_dir).where(F.col("id") == ANCHOR_PROVINCE_ID)
    j = S.contains_join(p, quakes(spark, sf_dir).withColumnRenamed("id", "quake_id"))
    return j.select("name", "id", "quake_id", "x_md", "y_md")


def _threshold(flag: str):
    return f"CASE WHEN '{flag}' = 'Y' THEN 5 ELSE 0 END"


@register("quakes_threshold", ssql(f"""
SELECT p.name, p.id, q.id AS quake_id, CAST(q.magnitude AS DOUBLE) AS magnitude
FROM prov p JOIN quakes q ON {inside_sql('p', 'q.x_md', 'q.y_md', True)}
WHERE p.id = {ANCHOR_PROVINCE_ID} AND q.magnitude >= {_threshold('Y')}"""))
def q_quakes_threshold(spark, sf_dir):
    p = provinces(spark, sf_dir).where(F.col("id") == ANCHOR_PROVINCE_ID)
    q = spark.sql("SELECT * FROM {q} WHERE magnitude >= CASE WHEN :flag = 'Y' THEN 5 ELSE 0 END",
                  args={"flag": "Y"}, q=quakes(spark, sf_dir))
    j = S.contains_join(p, q.withColumnRenamed("id", "quake_id"))
    return j.select("name", "id", "quake_id", F.col("magnitude").cast("double").alias("magnitude"))


@register("param_threshold", ssql(f"""
SELECT q.id, CAST(q.magnitude AS DOUBLE) AS magnitude FROM quakes q WHERE q.magnitude >= {_threshold('N')}"""))
def q_param_threshold(spark, sf_dir):
    """Bind parameter: 'Y' means magnitude >= 5, anything else (here 'N') means >= 0."""
    q = spark.sql("SELECT id, CAST(magnitude AS DOUBLE) AS magnitude FROM {q} "
                  "WHERE magnitude >= CASE WHEN :flag = 'Y' THEN 5 ELSE 0 END", args={"flag": "N"},
                  q=quakes(spark, sf_dir))
    return q


@register("quakes_at_sea", ssql(f"""
SELECT q.id FROM quakes q WHERE NOT EXISTS (SELECT 1 FROM prov p WHERE {inside_sql('p', 'q.x_md', 'q.y_md', True)})"""))
def q_quakes_at_sea(spark, sf_dir):
    return S.outside_all(provinces(spark, sf_dir), quakes(spark, sf_dir).select("id", "x_md", "y_md"), "id").select("id")


@register("spatial_anti_join", ssql(f"""
SELECT c.id, c.nombre FROM cities c WHERE NOT EXISTS (SELECT 1 FROM prov p WHERE {inside_sql('p', 'c.x_md', 'c.y_md', True)})"""))
def q_spatial_anti_join(spark, sf_dir):
    return S.outside_all(provinces(spark, sf_dir), cities(spark, sf_dir), "id").select("id", "nombre")


def _hav_sql(ax, ay, bx, by):
    la1, la2 = f"radians({ay} / 1000.0)", f"radians({by} / 1000.0)"
    return (f"2 * 6371.0088 * asin(sqrt(pow(sin(({la2} - {la1}) / 2), 2) + cos({la1}) * cos({la2}) * "
            f"pow(sin((radians({bx} / 1000.0) - radians({ax} / 1000.0)) / 2), 2)))")


@register("distance_join_points", ssql(f"""
SELECT q.id, CAST(q.magnitude AS DOUBLE) AS magnitude, c.nombre, round(d, 6) AS distance_km
FROM (SELECT q.*, c.nombre, {_hav_sql('c.x_md', 'c.y_md', 'q.x_md', 'q.y_md')} AS d
      FROM cities c, quakes q WHERE c.id = {ANCHOR_CITY_ID}) q
JOIN cities c ON c.id = {ANCHOR_CITY_ID} WHERE d <= 20"""))
def q_distance_join_points(spark, sf_dir):
    c = cities(spark, sf_dir).where(F.col("id") == ANCHOR_CITY_ID).select("nombre", F.col("x_md").alias("cx"),
                                                                          F.col("y_md").alias("cy"))
    q = quakes(spark, sf_dir).select("id", "magnitude", "x_md", "y_md")
    j = S.within_distance_points(c, q, 20.0, "cx", "cy", "x_md", "y_md")
    return j.select("id", F.col("magnitude").cast("double").alias("magnitude"), "nombre",
                    F.round("distance_km", 6).alias("distance_km"))


def _geodesic_sql(ax, ay, bx, by):
    """WGS-84 distance to first order in the flattening, in sums and differences of reduced-latitude sines."""
    f, a = "(1 / 298.257223563)", "6378.137"
    b1, b2 = (f"atan((1 - {f}) * tan(radians({y} / 1000.0)))" for y in (ay, by))
    cos_s = f"least(1.0, greatest(-1.0, sin({b1}) * sin({b2}) + cos({b1}) * cos({b2}) * cos(radians(({bx} - {ax}) / 1000.0))))"
    s = f"acos({cos_s})"
    plus = f"({s} - sin({s})) * pow(sin({b1}) + sin({b2}), 2) / (2 * (1 + {cos_s}))"
    minus = f"({s} + sin({s})) * pow(sin({b1}) - sin({b2}), 2) / (2 * (1 - {cos_s}))"
    return f"CASE WHEN {s} > 0 THEN {a} * ({s} - {f} / 2 * ({plus} + {minus})) ELSE 0.0 END"


@register("distance_join_ellipsoid", ssql(f"""
SELECT id, magnitude, nombre, round(d, 4) AS distance_km
FROM (SELECT q.id, CAST(q.magnitude AS DOUBLE) AS magnitude, c.nombre, {_geodesic_sql('c.x_md', 'c.y_md', 'q.x_md', 'q.y_md')} AS d
      FROM cities c, quakes q WHERE c.id = {ANCHOR_CITY_ID})
WHERE d <= 20"""))
def q_distance_join_ellipsoid(spark, sf_dir):
    """Quakes within 20 km of one city on the WGS-84 ellipsoid."""
    c = cities(spark, sf_dir).where(F.col("id") == ANCHOR_CITY_ID).select("nombre", F.col("x_md").alias("cx"),
                                                                          F.col("y_md").alias("cy"))
    q = quakes(spark, sf_dir).select("id", "magnitude", "x_md", "y_md")
    j = S.within_distance_points(c, q, 20.0, "cx", "cy", "x_md", "y_md", ellipsoidal=True)
    return j.select("id", F.col("magnitude").cast("double").alias("magnitude"), "nombre",
                    F.round("distance_km", 4).alias("distance_km"))


def _seg_sql():
    kx = f"({KPD} * cos(radians(q.y_md / 1000.0)))"
    ax = f"(CAST(e.a_x - q.x_md AS DOUBLE) / 1000.0 * {kx})"
    ay = f"(CAST(e.a_y - q.y_md AS DOUBLE) / 1000.0 * {KPD})"
    bx = f"(CAST(e.b_x - q.x_md AS DOUBLE) / 1000.0 * {kx})"
    by = f"(CAST(e.b_y - q.y_md AS DOUBLE) / 1000.0 * {KPD})"
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {len2} > 0 THEN least(1.0, greatest(0.0, -({ax} * {dx} + {ay} * {dy}) / {len2})) ELSE 0.0 END)"
    cx, cy = f"({ax} + {t} * {dx})", f"({ay} + {t} * {dy})"
    return f"sqrt({cx} * {cx} + {cy} * {cy})"


COAST_DIST = ("coast_dist", f"""
SELECT q.id, MIN(CASE WHEN {inside_sql('p', 'q.x_md', 'q.y_md', False)} THEN 0.0 ELSE {_seg_sql()} END) AS d
FROM quakes q CROSS JOIN edges e JOIN prov p ON p.id = e.id
WHERE e.name IN ({COAST})
GROUP BY q.id""")


def _coast_near(spark, sf_dir, ellipsoidal: bool = False):
    coast = provinces(spark, sf_dir).where(F.col("name").isin(*COAST_PROVINCES))
    return S.within_distance_polygons(coast, quakes(spark, sf_dir), 10.0, ellipsoidal=ellipsoidal)


@register("distance_join_polygon", ssql(f"""
SELECT q.id, CAST(q.magnitude AS DOUBLE) AS magnitude, round(cd.d, 6) AS distance_km
FROM quakes q JOIN coast_dist cd ON cd.id = q.id WHERE cd.d <= 10""", [COAST_DIST]))
def q_distance_join_polygon(spark, sf_dir):
    n = _coast_near(spark, sf_dir)
    return n.select("id", F.col("magnitude").cast("double").alias("magnitude"),
                    F.round("distance_km", 6).alias("distance_km"))


@register("offshore_near_coast", ssql(f"""
SELECT q.id, CAST(q.magnitude AS DOUBLE) AS magnitude
FROM quakes q JOIN coast_dist cd ON cd.id = q.id
WHERE cd.d <= 10 AND NOT EXISTS (SELECT 1 FROM prov p WHERE {inside_sql('p', 'q.x_md', 'q.y_md', False)})""",
    [COAST_DIST]))
def q_offshore_near_coast(spark, sf_dir):
    near = _coast_near(spark, sf_dir).select("id", "magnitude", "x_md", "y_md")
    off = S.outside_all(provinces(spark, sf_dir), near, "id", strict=False)
    return off.select("id", F.col("magnitude").cast("double").alias("magnitude"))


def _geodesic_coast_ctes() -> list[tuple[str, str]]:
    """Distance to the coast on WGS-84 by courses and arcs of the auxiliary sphere: how far the quake lies along the
    course from one end of an edge to the other, and the distance to that foot or to the nearer end."""
    f, a = "(1 / 298.257223563)", "6378.137"

    def cosine(b1, l1, b2, l2):
        return f"least(1.0, greatest(-1.0, sin({b1}) * sin({b2}) + cos({b1}) * cos({b2}) * cos({l2} - {l1})))"

    def course(b1, l1, b2, l2):
        return f"atan2(sin({l2} - {l1}) * cos({b2}), cos({b1}) * sin({b2}) - sin({b1}) * cos({b2}) * cos({l2} - {l1}))"

    def km(c, b1, b2):
        return (f"CASE WHEN acos({c}) > 0 THEN {a} * (acos({c}) - {f} / 2 * ((acos({c}) - sin(acos({c}))) * pow(sin({b1}) + sin({b2}), 2) / (2 * (1 + {c})) "
                f"+ (acos({c}) + sin(acos({c}))) * pow(sin({b1}) - sin({b2}), 2) / (2 * (1 - {c})))) ELSE 0.0 END")

    def reduced(y):
        return f"atan((1 - {f}) * tan(radians({y} / 1000.0)))"

    return [
        ("g1", f"""
SELECT q.id, {inside_sql('p', 'q.x_md', 'q.y_md', False)} AS touching,
       {reduced('e.a_y')} AS ab, radians(e.a_x / 1000.0) AS al, {reduced('e.b_y')} AS bb, radians(e.b_x / 1000.0) AS bl,
       {reduced('q.y_md')} AS qb, radians(q.x_md / 1000.0) AS ql
FROM quakes q CROSS JOIN edges e JOIN prov p ON p.id = e.id WHERE e.name IN ({COAST})"""),
        ("g2", f"""
SELECT *, {cosine('ab', 'al', 'qb', 'ql')} AS to_a, {cosine('bb', 'bl', 'qb', 'ql')} AS to_b, acos({cosine('ab', 'al', 'bb', 'bl')}) AS len,
       {course('ab', 'al', 'bb', 'bl')} AS heading, {course('ab', 'al', 'qb', 'ql')} AS bearing FROM g1"""),
        ("g3", f"""
SELECT *, least({km('to_a', 'ab', 'qb')}, {km('to_b', 'bb', 'qb')}) AS to_end,
       atan2(sin(acos(to_a)) * cos(bearing - heading), to_a) AS along FROM g2"""),
        ("g4", "SELECT *, asin(sin(ab) * cos(along) + cos(ab) * sin(along) * cos(heading)) AS fb FROM g3"),
        ("g5", "SELECT *, al + atan2(sin(heading) * sin(along) * cos(ab), cos(along) - sin(ab) * sin(fb)) AS fl FROM g4"),
        ("g6", f"SELECT *, {cosine('fb', 'fl', 'qb', 'ql')} AS to_foot FROM g5"),
        ("geodesic_coast", f"""
SELECT id, MIN(CASE WHEN touching THEN 0.0 WHEN along > 0 AND along < len THEN least(to_end, {km('to_foot', 'fb', 'qb')}) ELSE to_end END) AS d
FROM g6 GROUP BY id""")]


GEODESIC_COAST = _geodesic_coast_ctes()


@register("distance_join_polygon_ellipsoid", ssql("""
SELECT q.id, CAST(q.magnitude AS DOUBLE) AS magnitude, round(g.d, 4) AS distance_km
FROM quakes q JOIN geodesic_coast g ON g.id = q.id WHERE g.d <= 10""", GEODESIC_COAST))
def q_distance_join_polygon_ellipsoid(spark, sf_dir):
    """Quakes within 10 km of the coastal provinces, by geodesics on the WGS-84 ellipsoid."""
    n = _coast_near(spark, sf_dir, ellipsoidal=True)
    return n.select("id", F.col("magnitude").cast("double").alias("magnitude"), F.round("distance_km", 4).alias("distance_km"))


@register("offshore_near_coast_ellipsoid", ssql(f"""
SELECT q.id, CAST(q.magnitude AS DOUBLE) AS magnitude
FROM quakes q JOIN geodesic_coast g ON g.id = q.id
WHERE g.d <= 10 AND NOT EXISTS (SELECT 1 FROM prov p WHERE {inside_sql('p', 'q.x_md', 'q.y_md', False)})""", GEODESIC_COAST))
def q_offshore_near_coast_ellipsoid(spark, sf_dir):
    near = _coast_near(spark, sf_dir, ellipsoidal=True).select("id", "magnitude", "x_md", "y_md")
    off = S.outside_all(provinces(spark, sf_dir), near, "id", strict=False)
    return off.select("id", F.col("magnitude").cast("double").alias("magnitude"))


@register("polygon_area_km2", ssql("""
SELECT id, name, round(abs(SUM((radians(a_x / 1000.0) * cos(radians(a_y / 1000.0)) * 6371.0088)
                                * (radians(b_y / 1000.0) * 6371.0088)
                               - (radians(b_x / 1000.0) * cos(radians(b_y / 1000.0)) * 6371.0088)
                                * (radians(a_y / 1000.0) * 6371.0088)) / 2.0), 2) AS area_km2
FROM edges GROUP BY id, name"""))
def q_polygon_area(spark, sf_dir):
    return provinces(spark, sf_dir).select("id", "name", F.round(G.ring_area_km2("ring"), 2).alias("area_km2"))


def strong_quakes(spark, sf_dir, threshold: float = 6.0):
    return quakes(spark, sf_dir).where(F.col("magnitude") >= threshold)


def _cross(ax, ay, bx, by, px, py):
    return f"(({bx}) - ({ax})) * (({py}) - ({ay})) - (({by}) - ({ay})) * (({px}) - ({ax}))"


HULL_CTES = [
    ("hp", "SELECT DISTINCT CAST(x_md AS DOUBLE) AS x, CAST(y_md AS DOUBLE) AS y FROM quakes WHERE magnitude >= 6"),
    # extreme points in eight directions, in counter-clockwise order of their outward normals
    ("ext", """
SELECT 1 AS i, arg_max(x, x) AS x, arg_max(y, x) AS y FROM hp UNION ALL
SELECT 2, arg_max(x, x + y), arg_max(y, x + y) FROM hp UNION ALL
SELECT 3, arg_max(x, y), arg_max(y, y) FROM hp UNION ALL
SELECT 4, arg_max(x, y - x), arg_max(y, y - x) FROM hp UNION ALL
SELECT 5, arg_min(x, x), arg_min(y, x) FROM hp UNION ALL
SELECT 6, arg_min(x, x + y), arg_min(y, x + y) FROM hp UNION ALL
SELECT 7, arg_min(x, y), arg_min(y, y) FROM hp UNION ALL
SELECT 8, arg_max(x, x - y), arg_max(y, x - y) FROM hp"""),
    ("oct", """
SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM ext a JOIN ext b ON b.i = a.i % 8 + 1
WHERE NOT (a.x = b.x AND a.y = b.y)"""),
    # points strictly inside the octagon cannot be hull vertices
    ("surv", f"""
SELECT p.x, p.y FROM hp p
WHERE NOT (SELECT bool_and({_cross('o.ax', 'o.ay', 'o.bx', 'o.by_', 'p.x', 'p.y')} > 0) FROM oct o)"""),
    ("hedge", f"""
SELECT a.x, a.y FROM surv a JOIN surv b ON NOT (a.x = b.x AND a.y = b.y)
WHERE NOT EXISTS (SELECT 1 FROM surv p WHERE {_cross('a.x', 'a.y', 'b.x', 'b.y', 'p.x', 'p.y')} < 0)
  AND NOT EXISTS (SELECT 1 FROM surv p WHERE {_cross('a.x', 'a.y', 'b.x', 'b.y', 'p.x', 'p.y')} = 0
                  AND ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y) < 0
                       OR (p.x - b.x) * (a.x - b.x) + (p.y - b.y) * (a.y - b.y) < 0))"""),
    ("hv", "SELECT DISTINCT x, y FROM hedge"),
    ("p0", "SELECT x AS x0, y AS y0 FROM hv ORDER BY x, y LIMIT 1"),
]


@register("convex_hull", ssql("""
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN x = x0 AND y = y0 THEN -10.0 ELSE atan2(y - y0, x - x0) END) - 1
            AS BIGINT) AS vertex_index, x, y
FROM hv, p0""", HULL_CTES))
def q_convex_hull(spark, sf_dir):
    """Hull of the earthquakes with magnitude >= 6, counter-clockwise from the leftmost
    (then lowest) vertex."""
    return S.convex_hull(strong_quakes(spark, sf_dir), "x_md", "y_md")


def _clip_sql() -> str:
    a = "h[i + 1]"
    b = "h[CASE WHEN i + 1 = len(h) THEN 1 ELSE i + 2 END]"
    cur = "l[j + 1]"
    prev = "l[CASE WHEN j = 0 THEN len(l) ELSE j END]"

    def side(p):
        return f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"

    sc, sp = side(cur), side(prev)
    t = f"({sp} / ({sp} - {sc}))"
    inter = (f"{{'x': {prev}.x + {t} * ({cur}.x - {prev}.x), 'y': {prev}.y + {t} * ({cur}.y - {prev}.y)}}")
    step = (f"flatten(list_transform(range(0, len(l)), lambda j: CASE WHEN {sc} >= 0 THEN "
            f"(CASE WHEN {sp} < 0 THEN [{inter}, {cur}] ELSE [{cur}] END) "
            f"WHEN {sp} >= 0 THEN [{inter}] ELSE [] END))")
    return step


def _area_sql(ring: str) -> str:
    def proj(p):
        lat = f"radians({p}.y / 1000.0)"
        return f"(radians({p}.x / 1000.0) * cos({lat}) * 6371.0088)", f"({lat} * 6371.0088)"

    ax, ay = proj(f"{ring}[k]")
    bx, by = proj(f"{ring}[k + 1]")
    terms = f"list_transform(range(1, len({ring})), lambda k: {ax} * {by} - {bx} * {ay})"
    return f"abs(list_reduce({terms}, lambda acc, v: acc + v) / 2.0)"


CLIP_CTES = HULL_CTES + [
    ("hull_idx", """
SELECT row_number() OVER (ORDER BY CASE WHEN x = x0 AND y = y0 THEN -10.0 ELSE atan2(y - y0, x - x0) END) AS vi, x, y
FROM hv, p0"""),
    ("hl", "SELECT list({'x': x, 'y': y} ORDER BY vi) AS h FROM hull_idx"),
    ("sj", f"""
SELECT name, list_transform(ring[1:len(ring) - 1], lambda p: {{'x': CAST(p.x AS DOUBLE), 'y': CAST(p.y AS DOUBLE)}}) AS s
FROM prov WHERE name = '{CLIP_PROVINCE}'"""),
    ("clipped", f"""
SELECT name, l FROM (
  WITH RECURSIVE steps(name, i, l) AS (
    SELECT name, 0, s FROM sj
    UNION ALL
    SELECT name, i + 1, {_clip_sql()} FROM steps, hl WHERE i < len(h) AND len(l) > 0)
  SELECT name, i, l FROM steps) t
QUALIFY row_number() OVER (PARTITION BY name ORDER BY i DESC) = 1"""),
    ("closed", "SELECT name, CASE WHEN len(l) > 0 THEN list_append(l, l[1]) ELSE [] END AS c FROM clipped"),
]


@register("clip_by_hull", ssql(f"""
SELECT name, round(CASE WHEN len(c) > 3 THEN {_area_sql('c')} ELSE 0.0 END, 2) AS area_interseccion_km2,
       CAST(len(c) AS INTEGER) AS vertices FROM closed""", CLIP_CTES))
def q_clip_by_hull(spark, sf_dir):
    """Area (km^2, 2 places) of the clip province intersected with the strong-quake hull."""
    # the hull stays on the executors: its one row (the closed ring) and the province's meet in an aggregate
    hull = S.hull_ring(S.convex_hull(strong_quakes(spark, sf_dir), "x_md", "y_md"))
    prov = provinces(spark, sf_dir).where(F.col("name") == CLIP_PROVINCE) \
        .select("name", F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"),
                                                               p["y"].cast("double").alias("y"))).alias("ring"))
    both = prov.unionByName(hull, allowMissingColumns=True).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("name", "ring", "hull")]).where("name IS NOT NULL")
    clipped = both.select("name", S.clip_by_convex("ring", F.coalesce("hull", F.array().cast(S.RING_TYPE))).alias("clip"))
    area = F.when(F.size("clip") > 3, G.ring_area_km2("clip")).otherwise(F.lit(0.0))
    return clipped.select("name", F.round(area, 2).alias("area_interseccion_km2"), F.size("clip").alias("vertices"))


DISSOLVE_CTES = [
    ("e", f"SELECT id, a_x AS ax, a_y AS ay, b_x AS bx, b_y AS ey FROM edges WHERE name IN ({COAST})"),
    ("v", "SELECT DISTINCT ax AS vx, ay AS vy FROM e"),
    ("pts", """
SELECT DISTINCT e.id, e.ax, e.ay, e.bx, e.ey, v.vx, v.vy,
       CAST((v.vx - e.ax) * (e.bx - e.ax) + (v.vy - e.ay) * (e.ey - e.ay) AS DOUBLE)
       / ((e.bx - e.ax) * (e.bx - e.ax) + (e.ey - e.ay) * (e.ey - e.ay)) AS t
FROM e JOIN v ON (e.bx - e.ax) * (v.vy - e.ay) - (e.ey - e.ay) * (v.vx - e.ax) = 0
         AND v.vx BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx)
         AND v.vy BETWEEN least(e.ay, e.ey) AND greatest(e.ay, e.ey)"""),
    ("pieces", """
SELECT vx, vy, lead(vx) OVER w AS wx, lead(vy) OVER w AS wy FROM pts
WINDOW w AS (PARTITION BY id, ax, ay, bx, ey ORDER BY t)"""),
    ("norm", """
SELECT CASE WHEN vx < wx OR (vx = wx AND vy <= wy) THEN vx ELSE wx END AS x1,
       CASE WHEN vx < wx OR (vx = wx AND vy <= wy) THEN vy ELSE wy END AS y1,
       CASE WHEN vx < wx OR (vx = wx AND vy <= wy) THEN wx ELSE vx END AS x2,
       CASE WHEN vx < wx OR (vx = wx AND vy <= wy) THEN wy ELSE vy END AS y2
FROM pieces WHERE wx IS NOT NULL"""),
]


@register("dissolve_outline", ssql("SELECT x1, y1, x2, y2 FROM norm GROUP BY x1, y1, x2, y2 HAVING COUNT(*) = 1",
                                   DISSOLVE_CTES))
def q_dissolve_outline(spark, sf_dir):
    """Outline of the two coast provinces' union (their shared edge cancels)."""
    coast = provinces(spark, sf_dir).where(F.col("name").isin(*COAST_PROVINCES))
    return S.dissolve_outline(coast, "id")
