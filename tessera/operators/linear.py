"""Ordinary least squares over numbers and dummy-coded categories, as an R model formula reads them.

One pass sums the cross products of all columns (a task adds up its rows and hands on one small triangle), the driver
solves a system with one row per coefficient, and a second pass sums the squared residuals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levels_of(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct values of categorical columns in alphabetical order (a level is a coefficient, so they are few)."""
    if not columns:
        return {}
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s"))
    found = pairs.select("s.c", "s.v").where("v IS NOT NULL").distinct().collect()
    return {c: sorted(r["v"] for r in found if r["c"] == c) for c in columns}


def dummy_columns(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """``df`` with a 0/1 column ``<col>_<level>`` per level (without the first, the base level); a missing value or a
    level that is not listed gives NULL."""
    made = {}
    for c, values in levels.items():
        known = F.col(c).cast("string").isin(values)
        for v in values[1:] if drop_first else values:
            made[f"{c}_{v}"] = F.when(known, (F.col(c).cast("string") == v).cast("int"))
    return df.withColumns(made), list(made)


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """(rows, matrix of sums of products) of an intercept and the columns, over rows that have all of them."""
    kept = df.select(*[_name(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    size = len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)])
            total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": total[i, j]})

    sums = kept.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros((size, size))
    for r in sums:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["v"]
    return int(matrix[0, 0]), matrix


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic: the regularised incomplete beta function I_x(df/2, 1/2), x = df / (df + t^2)."""
    if not math.isfinite(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_part(1 - x, b, a)
    return _beta_part(x, a, b)


def _beta_part(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (converges fast for x below its mean)."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1)) if 1.0 != (a + b) * x / (a + 1) else 1e300
    out = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d)
            c = 1.0 + step / c
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


@dataclass(frozen=True)
class LinearFit:
    """Estimates by term; an aliased term (a combination of earlier ones) has none, as in R."""
    terms: list[str]
    estimates: list[float | None]
    std_errors: list[float | None]
    rows: int
    rss: float
    tss: float

    @property
    def rank(self) -> int:
        return sum(e is not None for e in self.estimates)

    @property
    def df(self) -> int:
        return self.rows - self.rank

    def prediction(self) -> Column:
        """Column expression over the design columns; NULL where one of them is."""
        out = F.lit(self.estimates[0] or 0.0)
        for term, e in zip(self.terms[1:], self.estimates[1:]):
            if e is not None:
                out = out + F.lit(e) * _name(term)
        return out

    def table(self) -> list[tuple]:
        """(term, estimate, std_error, t_value, p_value) rows."""
        rows = []
        for term, e, s in zip(self.terms, self.estimates, self.std_errors):
            t = e / s if e is not None and s else None
            rows.append((term, e, s, t, None if t is None else student_p(t, self.df)))
        return rows


def least_squares(df: DataFrame, columns: Sequence[str], label: str) -> LinearFit:
    """Fit of ``label`` on an intercept and the columns; rows with a missing value are left out (R's ``na.omit``)."""
    n, g = cross_products(df, [*columns, label])
    xx, xy = g[:-1, :-1], g[:-1, -1]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    unit, right = xx / np.outer(scale, scale), xy / scale
    keep: list[int] = []
    for j in range(len(unit)):
        rest = unit[j, j] - (unit[j, keep] @ np.linalg.solve(unit[np.ix_(keep, keep)], unit[keep, j]) if keep else 0.0)
        if rest > 1e-11:
            keep.append(j)
    inverse = np.linalg.inv(unit[np.ix_(keep, keep)]) if keep else np.zeros((0, 0))
    beta = inverse @ right[keep] / scale[keep]
    terms = ["intercept", *columns]
    estimates: list[float | None] = [None] * len(terms)
    for j, b in zip(keep, beta):
        estimates[j] = float(b)
    fit = LinearFit(terms, estimates, [None] * len(terms), n, 0.0, 0.0)
    kept = df.dropna(subset=[*columns, label])
    mean = float(g[0, -1] / n) if n else 0.0
    sums = kept.agg(F.sum(F.pow(F.col(label) - fit.prediction(), 2)).alias("rss"), F.sum(F.pow(F.col(label) - F.lit(mean), 2)).alias("tss")).first()
    rss, tss = float(sums["rss"] or 0.0), float(sums["tss"] or 0.0)
    sigma2 = rss / (n - len(keep)) if n > len(keep) else float("nan")
    errors: list[float | None] = [None] * len(terms)
    for i, j in enumerate(keep):
        errors[j] = float(math.sqrt(max(0.0, sigma2 * inverse[i, i])) / scale[j])
    return LinearFit(terms, estimates, errors, n, rss, tss)
