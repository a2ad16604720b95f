"""DuckDB oracle CTEs for the classification and regression studies."""

from __future__ import annotations

from .oracle import fx, with_ctes

WF = [f"f{i}" for i in range(1, 12)]
FF = ["brightness", "radiative_power", "relative_humidity", "soil_water"]
WCOLS = "row_id, " + ", ".join(WF) + ", quality"


def _zscore_ctes() -> list[tuple[str, str]]:
    ctes = [("z0", f"SELECT row_id, {', '.join(WF)}, CAST(quality > 5 AS INTEGER) AS quality FROM wine")]
    for i, c in enumerate([*WF, "quality"], start=1):
        ctes.append((f"z{i}", f"""
SELECT p.* FROM z{i - 1} p, (SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM z{i - 1}) st
WHERE st.s > 0 AND abs((p.{c} - st.m) / st.s) <= 3"""))
    return ctes


def _scaled(src: str, params: str, kind: str) -> str:
    if kind == "minmax":
        cols = ", ".join(f"({c} - mn_{c}) / (CASE WHEN mx_{c} <> mn_{c} THEN mx_{c} - mn_{c} ELSE 1.0 END) AS {c}"
                         for c in WF)
    else:
        cols = ", ".join(f"({c} - mu_{c}) / (CASE WHEN sd_{c} <> 0 THEN sd_{c} ELSE 1.0 END) AS {c}" for c in WF)
    return f"SELECT row_id, copy_index, quality, {cols} FROM {src}, {params}"


WINE_CTES = fx("wine") + _zscore_ctes() + [
    ("wclean", f"SELECT * FROM z{len(WF) + 1}"),
    ("ws", """
SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', '42', row_id)), row_id) AS rk,
       COUNT(*) OVER (PARTITION BY quality) AS gn FROM wclean"""),
    ("wtest", f"SELECT {WCOLS}, CAST(NULL AS INTEGER) AS copy_index FROM ws WHERE rk <= ceil(gn * CAST(0.2 AS DOUBLE))"),
    ("wtrain_raw", f"SELECT {WCOLS} FROM ws WHERE rk > ceil(gn * CAST(0.2 AS DOUBLE))"),
    ("tr", f"""
SELECT {WCOLS}, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', '42', row_id)), row_id) AS rk2
FROM wtrain_raw"""),
    ("cnt", "SELECT quality, COUNT(*) AS n FROM wtrain_raw GROUP BY quality"),
    ("extra", """
SELECT c.quality, c.n, g.j FROM cnt c, (SELECT MAX(n) AS m FROM cnt) t, generate_series(0, t.m - c.n - 1) AS g(j)
WHERE c.n < t.m"""),
    ("picks", """
SELECT quality, j, 1 + CAST(('0x' || substr(md5(concat_ws('|', '42', quality, j)), 1, 15)) AS BIGINT) % n AS rk2 FROM extra"""),
    ("wtrain", f"""
SELECT {WCOLS}, CAST(NULL AS INTEGER) AS copy_index FROM tr
UNION ALL
SELECT {", ".join("tr." + c for c in WCOLS.split(", "))}, CAST(p.j AS INTEGER) AS copy_index
FROM picks p JOIN tr ON tr.quality = p.quality AND tr.rk2 = p.rk2"""),
    ("mm", "SELECT " + ", ".join(f"MIN({c}) AS mn_{c}, MAX({c}) AS mx_{c}" for c in WF) + " FROM wtrain"),
    ("sdp", "SELECT " + ", ".join(f"AVG({c}) AS mu_{c}, STDDEV_POP({c}) AS sd_{c}" for c in WF) + " FROM wtrain"),
    ("smm", _scaled("wtest", "mm", "minmax")),
    ("sq", _scaled("wtest", "sdp", "standard")),
    ("sr", _scaled("wtrain", "sdp", "standard")),
    ("wnn", f"""
SELECT * FROM (
  SELECT q.row_id AS qid, r.row_id AS rid, COALESCE(r.copy_index, -1) AS rc, CAST(r.quality AS DOUBLE) AS y,
         {" + ".join(f"(q.{c} - r.{c}) * (q.{c} - r.{c})" for c in WF)} AS dist,
         row_number() OVER (PARTITION BY q.row_id ORDER BY
            {" + ".join(f"(q.{c} - r.{c}) * (q.{c} - r.{c})" for c in WF)}, r.row_id, COALESCE(r.copy_index, -1)) AS rn
  FROM sq q, sr r) t WHERE rn <= 11"""),
    ("wpred", """
SELECT t.row_id, t.quality, p.probability, CAST(p.probability > 0.5 AS INTEGER) AS prediction
FROM wtest t JOIN (SELECT qid, AVG(y) AS probability FROM wnn GROUP BY qid) p ON p.qid = t.row_id"""),
]

FIRE_CTES = fx("fires") + [
    ("fr", """
SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', row_id)), row_id) AS rk, COUNT(*) OVER () AS n FROM fires"""),
    ("ftest", "SELECT * FROM fr WHERE rk <= ceil(n * CAST(0.2 AS DOUBLE))"),
    ("ftrain", "SELECT * FROM fr WHERE rk > ceil(n * CAST(0.2 AS DOUBLE))"),
    ("fnn", f"""
SELECT * FROM (
  SELECT q.row_id AS qid, r.row_id AS rid, r.fire_area AS y,
         row_number() OVER (PARTITION BY q.row_id ORDER BY
            {" + ".join(f"(q.{c} - r.{c}) * (q.{c} - r.{c})" for c in FF)}, r.row_id) AS rn
  FROM ftest q, ftrain r) t WHERE rn <= 15"""),
    ("fpred", """
SELECT t.row_id, t.fire_area, p.prediction FROM ftest t JOIN (SELECT qid, AVG(y) AS prediction FROM fnn GROUP BY qid) p
ON p.qid = t.row_id"""),
]


def wsql(body: str, extra=None) -> str:
    return with_ctes(WINE_CTES + list(extra or []), body)


def fsql(body: str, extra=None) -> str:
    return with_ctes(FIRE_CTES + list(extra or []), body)
