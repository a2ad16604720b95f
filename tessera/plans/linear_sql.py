"""DuckDB SQL of a least-squares fit: cross products, Gauss-Jordan elimination, residuals, p-values by quadrature."""

from __future__ import annotations


def lm_ctes(source: str, terms: dict[str, str], label: str) -> list[tuple[str, str]]:
    """CTEs ``lm`` (i, term, estimate, std_error, t_value, p_value) and ``lm_fit`` (n, rank, rss, tss) for the fit of
    ``label`` on an intercept and the terms (name -> SQL expression) over the rows of ``source``."""
    names, p = ["intercept", *terms], len(terms) + 1
    z = ", ".join([f"CAST({e} AS DOUBLE) AS z{i}" for i, e in enumerate(["1.0", *terms.values()], 1)])
    cells = ",\n".join("[" + ", ".join([f"SUM(z{min(i, j)} * z{max(i, j)})" for j in range(1, p + 1)] + [f"SUM(z{i} * y)"]
                                       + ["1.0" if i == j else "0.0" for j in range(1, p + 1)]) + "]" for i in range(1, p + 1))
    fitted = " + ".join(f"m[{i}][{p + 1}] * z{i}" for i in range(1, p + 1))
    return [
        ("lmz", f"SELECT {z}, CAST({label} AS DOUBLE) AS y FROM {source}"),
        ("lmg", f"SELECT [{cells}] AS m FROM lmz"),
        ("lms", f"""
SELECT 1 AS k, m FROM lmg UNION ALL
SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k])
                                             ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END)
FROM lms WHERE k <= {p}"""),
        ("lmb", f"SELECT m FROM lms WHERE k = {p + 1}"),
        ("lm_fit", f"""
SELECT COUNT(*) AS n, {p} AS rank, SUM(pow(y - ({fitted}), 2)) AS rss, SUM(pow(y - (SELECT AVG(y) FROM lmz), 2)) AS tss FROM lmz, lmb"""),
        ("lm0", " UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS term, m[{i}][{p + 1}] AS estimate, "
                                   f"sqrt(rss / (n - rank) * m[{i}][{p + 1 + i}]) AS std_error, n - rank AS df FROM lmb, lm_fit"
                                   for i, n in enumerate(names, 1))),
        ("lm1", "SELECT *, estimate / std_error AS t_value FROM lm0"),
        # Simpson's rule over the density of t between 0 and |t|
        ("lmp", """
SELECT l.i, 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * abs(t_value) / 4000 / 3
              * SUM((CASE WHEN s.j IN (0, 4000) THEN 1 WHEN s.j % 2 = 1 THEN 4 ELSE 2 END)
                    * pow(1 + pow(t_value * s.j / 4000, 2) / df, -(df + 1) / 2.0)) AS p
FROM lm1 l, range(4001) s(j) WHERE abs(t_value) <= 50 GROUP BY l.i, df, t_value"""),
        ("lm", "SELECT l.*, CASE WHEN abs(t_value) > 50 THEN 0.0 ELSE greatest(p, 0.0) END AS p_value FROM lm1 l LEFT JOIN lmp ON lmp.i = l.i"),
    ]


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def significant_sql(x: str, digits: int = 6) -> str:
    return f"CAST(printf('%.{digits - 1}e', CAST({x} AS DOUBLE)) AS DOUBLE)"
