"""Regularised additive bias model for ratings (global mean + staged group biases).

Stage k fits, for every value of its key, b_k = sum(residual) / (n + lambda) where
the residual is the rating minus the mean and all earlier biases; unseen keys get
NULL (left joins), as in the reference.  The model is plain aggregates and joins:

* a lambda grid is evaluated **wide**, one sum per lambda and key, but no row with a
  column per lambda is ever shuffled or written: rows meet the first stage's (n, sum) of
  their key, from which any lambda's bias follows, and the later coefficient tables;
* a factor with many keys (users) gets its rows, few narrow columns, shuffled by the key,
  so that its sums are complete in place; one with few keys is summed where the rows are;
* the factors with few keys at the end share one pass over the joined rows.  It sums the
  residual left by the factors before them; what the earlier of the few-key factors take
  off needs only the rows' own keys and tables that are broadcast;
* a key column that may be NULL (publication year) is matched NULL-safely.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .folds import side_by_side

# The lambda grid 0, 0.25, …, 10 (41 points).
LAMBDA_GRID = [i * 0.25 for i in range(41)]

#: lambdas of one pass
CHUNK = 41
#: a factor has few keys while its table, a sum per key and lambda, has at most so many numbers
FEW_SUMS = 1 << 18


def _lam_tag(i: int) -> str:
    return f"l{i}"


@dataclass
class BiasModel:
    mu: float
    factors: list[str]
    lambdas: list[float]
    tables: dict[str, DataFrame]  # factor -> written (key, _n, _s) for the first, (key, b_<factor>_<lambda tag>...) for others

    def coef(self, factor: str, i: int) -> str:
        return f"b_{factor}_{_lam_tag(i)}"

    def bias(self, factor: str, i: int) -> Column:
        """The factor's bias at lambda number i, over the columns of its table."""
        if factor == self.factors[0]:
            return F.col(f"_s_{factor}") / (F.col(f"_n_{factor}") + F.lit(self.lambdas[i]))
        return F.col(self.coef(factor, i))


def _join_coef(df: DataFrame, table: DataFrame, factor: str) -> DataFrame:
    """Left join of a coefficient table (written parquet).  The planner sizes it from its
    files: below ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast, above it the
    join shuffles – a size check without an extra job."""
    return df.join(table, df[factor].eqNullSafe(table[f"_k_{factor}"]), "left").drop(f"_k_{factor}")


def _residuals(model: BiasModel, rows: DataFrame, label: str, done: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and one column per lambda: the label minus the mean and the biases of the factors in ``done``."""
    for f in done:
        rows = _join_coef(rows, model.tables[f], f)
    left = []
    for i in range(len(model.lambdas)):
        r = F.col(label) - F.lit(model.mu)
        for f in done:
            r = r - model.bias(f, i)
        left.append(r.alias(f"_r{i}"))
    return rows.select(*keep, *left)


def _numbered(train: DataFrame, factor: str, name: str) -> DataFrame:
    """(factor, number from 0) of a factor with few keys, so the window is small."""
    return materialize(train.select(factor).distinct().select(
        F.col(factor).alias(f"_k_{factor}"), (F.row_number().over(Window.orderBy(factor)) - 1).cast("int").alias(name)), "bias-keys")


def _fit_last(model: BiasModel, train: DataFrame, label: str, last: Sequence[str]) -> None:
    """Tables of the factors with few keys at the end: one pass over the joined rows sums, by each of them, what the
    factors before leave; then every factor takes off what the earlier ones of ``last`` take."""
    done, n_l = [f for f in model.factors if f in model.tables], len(model.lambdas)
    numbers = {f: _numbered(train, f, f"_i{j}") for j, f in enumerate(last)}
    rows = train.select(*dict.fromkeys([label, *done, *last]))
    for j, f in enumerate(last):
        rows = rows.join(F.broadcast(numbers[f]), rows[f].eqNullSafe(numbers[f][f"_k_{f}"])).drop(f"_k_{f}")
    names = [f"_i{j}" for j in range(len(last))]
    rows = rows.select(*dict.fromkeys([label, *done]), *names)
    left = _residuals(model, rows, label, done, names)
    sums = left.groupingSets([[c] for c in names], *names).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_r{i}").alias(f"_a{i}") for i in range(n_l)])
    sums = materialize(sums, "bias-sums")
    for j, f in enumerate(last):
        own = sums.where(F.col(f"_i{j}").isNotNull()).drop(*[c for c in names if c != f"_i{j}"])
        own = own.join(F.broadcast(numbers[f]), f"_i{j}").drop(f"_i{j}")
        if j:
            taken = train.select(*dict.fromkeys([label, *last[:j + 1]]))
            for g in last[:j]:
                taken = _join_coef(taken, model.tables[g], g)
            off = [sum((model.bias(g, i) for g in last[1:j]), model.bias(last[0], i)) for i in range(n_l)]
            off = taken.groupBy(F.col(f).alias("_key")).agg(*[F.sum(F.when(F.col(label).isNotNull(), b)).alias(f"_o{i}") for i, b in enumerate(off)])
            own = own.join(off, own[f"_k_{f}"].eqNullSafe(off["_key"]))
        table = own.select(f"_k_{f}", *[((F.col(f"_a{i}") - F.col(f"_o{i}") if j else F.col(f"_a{i}")) / (F.col("_n") + F.lit(lam))).alias(model.coef(f, i))
                                        for i, lam in enumerate(model.lambdas)])
        model.tables[f] = materialize(table, f"bias-{f}")


def fit(train: DataFrame, label: str, factors: Sequence[str], lambdas: Sequence[float] = (0.0,), mu: float | None = None) -> BiasModel:
    """Fit mean + one bias per factor in order, for every lambda at once (wide; see :func:`grid_curve` for many).

    The first stage's residual (label - mu) does not depend on lambda: its table holds one sum and count per key."""
    lambdas, factors = list(lambdas), list(factors)
    size = train.agg(F.avg(label).alias("mu"), *[F.approx_count_distinct(f).alias(f"_d{i}") for i, f in enumerate(factors)]).first()
    few = [size[f"_d{i}"] * len(lambdas) <= FEW_SUMS for i in range(len(factors))]
    mu = size["mu"] if mu is None else mu
    model = BiasModel(mu, factors, lambdas, {})
    first = len(factors)
    while first > 1 and few[first - 1]:
        first -= 1  # factors[first:] have few keys
    for stage, f in enumerate(factors[:first]):
        if stage == 0:
            sums = train.groupBy(F.col(f).alias(f"_k_{f}")).agg(F.count(F.lit(1)).alias(f"_n_{f}"), F.sum(F.col(label) - F.lit(mu)).alias(f"_s_{f}"))
            model.tables[f] = materialize(sums, f"bias-{f}")
            continue
        rows = train.select(*dict.fromkeys([label, *factors[:stage + 1]]))
        if not few[stage]:
            for g in factors[:stage]:
                rows = _join_coef(rows, model.tables[g], g)
            rows = rows.drop(*[g for g in factors[:stage] if g != f]).repartition(f)  # complete sums in place of a part of every key from every task
            left = [F.col(label) - F.lit(mu)] * len(lambdas)
            for i in range(len(lambdas)):
                for g in factors[:stage]:
                    left[i] = left[i] - model.bias(g, i)
            sums = rows.groupBy(f).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(r).alias(f"_a{i}") for i, r in enumerate(left)])
        else:
            left = _residuals(model, rows, label, factors[:stage], [f])
            sums = left.groupBy(f).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_r{i}").alias(f"_a{i}") for i in range(len(lambdas))])
        model.tables[f] = materialize(sums.select(F.col(f).alias(f"_k_{f}"), *[(F.col(f"_a{i}") / (F.col("_n") + F.lit(lam))).alias(model.coef(f, i))
                                                                         for i, lam in enumerate(lambdas)]), f"bias-{f}")
    if first < len(factors):
        _fit_last(model, train, label, factors[first:])
    return model


def prefix(model: BiasModel, k: int) -> BiasModel:
    """The model of the first k factors: stages are fitted in order, so they are the same."""
    return BiasModel(model.mu, model.factors[:k], model.lambdas, model.tables)


def predict(model: BiasModel, df: DataFrame, prefix: str = "pred", fill_unseen: bool = False) -> DataFrame:
    """One prediction column per lambda: mu + sum of the biases.  A key unseen in training
    makes the prediction NULL (R's NA; counted by ``metrics.rmse``), or adds 0 with
    ``fill_unseen``.

    The first factor brings (n, sum) only, and the biases are added up after the last join."""
    out = df
    for f in model.factors:
        out = _join_coef(out, model.tables[f], f)
    preds = []
    for i in range(len(model.lambdas)):
        p = F.lit(model.mu)
        for f in model.factors:
            b = model.bias(f, i)
            p = p + (F.coalesce(b, F.lit(0.0)) if fill_unseen else b)
        preds.append(p.alias(f"{prefix}_{_lam_tag(i)}"))
    return out.select(*df.columns, *preds)


def grid_rmse(model: BiasModel, test: DataFrame, label: str) -> DataFrame:
    """(lambda, rmse, null_predictions) for every lambda from one aggregate over the test set."""
    p = predict(model, test.select(*dict.fromkeys([label, *model.factors])))
    aggs = []
    for i in range(len(model.lambdas)):
        e = F.col(label) - F.col(f"pred_{_lam_tag(i)}")
        aggs += [F.sqrt(F.avg(e * e)).alias(f"rmse{i}"),
                 F.sum(F.col(f"pred_{_lam_tag(i)}").isNull().cast("bigint")).alias(f"null{i}")]
    row = p.agg(*aggs)
    structs = [F.struct(F.lit(float(lam)).alias("lambda"), F.col(f"rmse{i}").alias("rmse"),
                        F.col(f"null{i}").alias("null_predictions")) for i, lam in enumerate(model.lambdas)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def grid_curve(train: DataFrame, test: DataFrame, label: str, factors: Sequence[str], lambdas: Sequence[float],
               chunk: int = CHUNK) -> DataFrame:
    """(lambda, rmse, null_predictions) of the model of all factors for every lambda, a chunk of them at a time."""
    lambdas = list(lambdas)
    mu = train.agg(F.avg(label)).first()[0]
    parts = [lambdas[i:i + chunk] for i in range(0, len(lambdas), chunk)]

    def curve(part: list[float]) -> DataFrame:
        return materialize(grid_rmse(fit(train, label, factors, part, mu), test, label), "lambda-chunk")

    return reduce(DataFrame.unionByName, side_by_side([lambda p=p: curve(p) for p in parts]))


def best_lambda(curve: DataFrame) -> float:
    """First lambda with the smallest RMSE (which.min); the curve has one row per lambda."""
    return curve.orderBy(F.col("rmse").asc_nulls_last(), "lambda").first()["lambda"]


def coefficients(model: BiasModel, factor: str, i: int = 0) -> DataFrame:
    return model.tables[factor].select(F.col(f"_k_{factor}").alias(factor), model.bias(factor, i).alias(f"b_{factor}"))
