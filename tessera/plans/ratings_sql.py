"""DuckDB oracle CTEs for the ratings study (working set and the two splits)."""

from __future__ import annotations

from .oracle import fx, with_ctes

COLS = "userid, movieid, rating, rated_at, title, genres, day, year_publication"


def _split(src: str, out: str, frac: float) -> list[tuple[str, str]]:
    return [
        (f"{out}_g", f"""
SELECT s.*, greatest(1, len(list_filter(q.b, lambda x: x < s.rating))) AS grp
FROM {src} s, (SELECT list_distinct(quantile_cont(rating, [0.0, 0.25, 0.5, 0.75, 1.0])) AS b FROM {src}) q"""),
        (f"{out}_r", f"""
SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('|', '42', userid, movieid)), userid, movieid) AS rk,
       COUNT(*) OVER (PARTITION BY grp) AS gn
FROM {out}_g"""),
        (f"{out}_in", f"SELECT {COLS} FROM {out}_r WHERE rk <= ceil(gn * CAST({frac} AS DOUBLE))"),
        (f"{out}_out", f"SELECT {COLS} FROM {out}_r WHERE rk > ceil(gn * CAST({frac} AS DOUBLE))"),
    ]


RATING_CTES = fx("ratings", "movies") + [
    ("ml", f"""
SELECT r.userid, r.movieid, r.rating, r.rated_at, m.title, m.genres,
       date_trunc('day', r.rated_at + INTERVAL 12 HOURS) AS day,
       TRY_CAST(NULLIF(regexp_extract(m.title, '\\((\\d{{4}})\\)', 1), '') AS INTEGER) AS year_publication
FROM ratings r LEFT JOIN movies m ON r.movieid = m.movieid"""),
    *_split("ml", "h", 0.1),
    ("final_holdout", f"""
SELECT {COLS} FROM h_in WHERE movieid IN (SELECT movieid FROM h_out) AND userid IN (SELECT userid FROM h_out)"""),
    ("removed", f"""
SELECT {COLS} FROM h_in t WHERE NOT EXISTS (SELECT 1 FROM final_holdout f WHERE f.userid = t.userid AND f.movieid = t.movieid)"""),
    ("edx", f"SELECT {COLS} FROM h_out UNION ALL SELECT {COLS} FROM removed"),
    *_split("edx", "e", 0.8),
    ("train", f"SELECT {COLS} FROM e_in"),
    ("test0", f"SELECT {COLS} FROM e_out"),
    ("test", f"""
SELECT {COLS} FROM test0 WHERE movieid IN (SELECT movieid FROM train) AND userid IN (SELECT userid FROM train)"""),
]


def rsql(body: str, extra=None) -> str:
    return with_ctes(RATING_CTES + list(extra or []), body)


def bias_ctes(train: str, lam_sql: str, factors: list[str], prefix: str = "") -> list[tuple[str, str]]:
    """Staged biases for every lambda in the CTE ``lams(lam)`` (long form: one row per
    (lambda, key)); joins are NULL-safe (IS NOT DISTINCT FROM) like dplyr's."""
    ctes = [(f"{prefix}lams", lam_sql), (f"{prefix}mu", f"SELECT AVG(rating) AS mu FROM {train}")]
    done: list[str] = []
    for f in factors:
        joins = "".join(f" LEFT JOIN {prefix}b_{d} ON {prefix}b_{d}.lam = l.lam AND {prefix}b_{d}.k IS NOT DISTINCT FROM t.{d}"
                        for d in done)
        resid = "t.rating - m.mu" + "".join(f" - {prefix}b_{d}.b" for d in done)
        ctes.append((f"{prefix}b_{f}", f"""
SELECT l.lam, t.{f} AS k, SUM({resid}) / (COUNT(*) + l.lam) AS b
FROM {train} t CROSS JOIN {prefix}lams l CROSS JOIN {prefix}mu m{joins}
GROUP BY l.lam, t.{f}"""))
        done.append(f)
    return ctes


def predict_sql(test: str, factors: list[str], prefix: str = "") -> str:
    joins = "".join(f" LEFT JOIN {prefix}b_{d} ON {prefix}b_{d}.lam = l.lam AND {prefix}b_{d}.k IS NOT DISTINCT FROM t.{d}"
                    for d in factors)
    pred = "m.mu" + "".join(f" + {prefix}b_{d}.b" for d in factors)
    return f"""
SELECT l.lam, t.userid, t.movieid, t.rating, {pred} AS pred
FROM {test} t CROSS JOIN {prefix}lams l CROSS JOIN {prefix}mu m{joins}"""


def lam_list(values) -> str:
    return " UNION ALL ".join(f"SELECT CAST({v} AS DOUBLE) AS lam" for v in values)


def grid_lams() -> str:
    return "SELECT CAST(range AS DOUBLE) * 0.25 AS lam FROM range(41)"
