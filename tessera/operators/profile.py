"""Profiling aggregates: null counts, distinct counts, summaries, histograms, box plots,
correlations.  Each is one or two aggregate passes whose output size does not grow
with the data (one row per column, bin, group or column pair)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import join_nullsafe


def _interpolate(out: DataFrame, g: list, names: list, n_probs: int) -> DataFrame:
    res = []
    for i, nm in enumerate(names):
        p_, lo, hi = F.col(f"_p{i}"), F.floor(F.col(f"_p{i}")), F.ceil(F.col(f"_p{i}"))
        # same interpolation as Spark's percentile: (hi - pos) * v_lo + (pos - lo) * v_hi
        res.append(F.when(lo == hi, F.col(f"_lo{i}"))
                   .otherwise((hi - p_) * F.col(f"_lo{i}") + (p_ - lo) * F.col(f"_hi{i}")).alias(nm))
    return out.select(*g, *res)


def value_histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., _v, _c): rows per group and value, written once; a value repeated in a third of all rows is one row."""
    from ..session import materialize
    base = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    return materialize(base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), "value-hist")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, hist: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (as ``percentile`` / ``quantile_cont``)
    per group, without gathering a group's values in one task.

    The rank interval each value of the histogram covers follows from the range-partitioned
    prefix sum over the histogram, whose keys are unique, and only the values at the
    interpolation positions floor/ceil(p (n - 1)) are aggregated.  One row per group (NULL is
    a group) is returned with one column per probability."""
    from .windows import global_cumsum
    g = list(by)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    hist = value_histogram(df, value, g) if hist is None else hist
    cum = global_cumsum(hist, [*[F.col(c).asc_nulls_first() for c in g], F.col("_v")], ["_c"], prefix="_all_")
    if g:
        sizes = cum.groupBy(*g).agg(F.sum("_c").alias("_n"), F.min(F.col("_all__c") - F.col("_c")).alias("_off"))
        h = join_nullsafe(cum, sizes, g, "inner")
    else:
        total = hist.agg(F.sum("_c")).first()[0]
        h = cum.withColumn("_n", F.lit(total)).withColumn("_off", F.lit(0))
    h = h.withColumn("_cum", F.col("_all__c") - F.col("_off"))
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        covers = lambda r: (F.col("_cum") - F.col("_c") <= r) & (r < F.col("_cum"))
        aggs += [F.max(F.when(covers(F.floor(pos)), F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(covers(F.ceil(pos)), F.col("_v"))).alias(f"_hi{i}"), F.first(pos).alias(f"_p{i}")]
    return _interpolate(h.groupBy(*g).agg(*aggs), g, names, len(probs))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One pass: NULL (and NaN) count per column, returned long: column_name, null_count."""
    cols = list(columns or df.columns)
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    missing = {c: F.col(c).isNull() | F.isnan(c) if c in real else F.col(c).isNull() for c in cols}
    wide = df.agg(*[F.sum(missing[c].cast("bigint")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count") \
        .select("column_name", F.coalesce("null_count", F.lit(0)).cast("bigint").alias("null_count"))


def value_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias(name)) \
        .orderBy(F.col(name).desc(), *keys)


def group_means(df: DataFrame, keys: Sequence[str], means: dict[str, str], count_name: str = "appearances",
                scale: int | None = None) -> DataFrame:
    """Count plus the means of several columns per group (``means``: output -> column)."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias(count_name)]
    for out, c in means.items():
        a = F.avg(c)
        aggs.append((F.round(a, scale) if scale is not None else a).alias(out))
    return df.groupBy(*keys).agg(*aggs)


def global_stats(df: DataFrame, columns: Sequence[str], strict: bool = False, scale: int = 6) -> DataFrame:
    """Mean, min, max per column (long form).  ``strict`` mirrors R: any NULL -> NULL stats."""
    rows = []
    for c in columns:
        nulls = F.sum(F.col(c).isNull().cast("int"))
        guard = (lambda e: F.when(nulls == 0, e)) if strict else (lambda e: e)
        rows.append(F.struct(F.lit(c).alias("column_name"),
                             guard(F.round(F.avg(c), scale)).cast("double").alias("mean"),
                             guard(F.round(F.min(c).cast("double"), scale)).alias("min"),
                             guard(F.round(F.max(c).cast("double"), scale)).alias("max")))
    return df.agg(F.array(*rows).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def distinct_per_group(df: DataFrame, key: str, attr: str, name: str = "distinct_values") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(attr).cast("bigint").alias(name))


def histogram(df: DataFrame, column: str, bins: int = 30, by: Sequence[str] = (), binwidth: float | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), empty bins included; ``binwidth`` sets
    the width instead of the number of bins, which then start at a multiple of it.
    Two passes: one for the range, one for the counts; the bin spine has ``bins`` rows."""
    rng = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin bigint, bin_lo double, bin_hi double, n bigint")
    if binwidth:
        lo = math.floor(float(lo) / binwidth) * binwidth
        bins = math.floor((float(hi) - lo) / binwidth) + 1
    width = binwidth or ((float(hi) - float(lo)) / bins if hi != lo else 1.0)
    b = F.least(F.floor((F.col(column).cast("double") - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1))
    counts = df.where(F.col(column).isNotNull()).groupBy(b.cast("bigint").alias("bin"), *by) \
        .agg(F.count(F.lit(1)).alias("n"))
    if by:
        # one spine row per (group, bin), generated from the distinct groups
        spine = df.select(*by).distinct().select(
            *by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    else:
        spine = spark.range(bins).withColumnRenamed("id", "bin")
    out = join_nullsafe(spine, counts, ["bin", *by], "left")
    return out.select("bin", *by, (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      (F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                      F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def boxplot_stats(df: DataFrame, value: str, by: Sequence[str], scale: int = 6) -> DataFrame:
    """Quartiles (linear interpolation), 1.5 IQR whiskers and outlier count per group (NULL is a group).

    All of it is read off the (group, value) histogram; the rows are not joined again."""
    hist = value_histogram(df, value, by)
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"], hist=hist)
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
        .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = join_nullsafe(hist, q, by, "inner")
    inside = (F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence"))
    agg = j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("outliers"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return join_nullsafe(agg, sizes, by, "inner").select(
        *by, *[F.round(c, scale).cast("double").alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
        F.col("outliers").cast("bigint").alias("outliers"), "n")


def _pair_sums(batches: Iterator[pa.RecordBatch], shift: list[float]) -> Iterator[pa.RecordBatch]:
    """Of all column pairs (i, j) over the rows that have both: rows, sums and sums of squares of i, sums of i * j."""
    total = np.zeros((4, len(shift), len(shift)))
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
        has = ~np.isnan(x)
        x, has = np.where(has, x, 0.0), has.astype(float)
        total += np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
    i, j = np.indices(total.shape[1:]).reshape(2, -1)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                      **{c: total[k].ravel() for k, c in enumerate(("n", "s", "q", "p"))}})


def correlation_matrix(df: DataFrame, columns: Sequence[str], scale: int = 2) -> DataFrame:
    """Pearson correlations of every column pair, long form (var1, var2, value) – the
    melted matrix.

    A pair's covariance and deviations are over the rows where both columns have a value (NULL and NaN are none).  One
    pass over the rows: a task adds up k x k matrix products, and their sums give all cells.  Values are shifted by the
    mean of the first rows, so that squares do not swamp the deviations.  A constant column has no correlation: NULL."""
    cols = list(columns)
    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    head = wide.limit(64).toArrow()
    first = [[v for v in head.column(i).to_pylist() if v is not None and v == v] for i in range(len(cols))]
    shift = [sum(v) / len(v) if v else 0.0 for v in first]
    sums = wide.mapInArrow(lambda batches: _pair_sums(batches, shift), "i int, j int, n double, s double, q double, p double") \
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "p")])
    cell = {(r["i"], r["j"]): r for r in sums.collect()}  # k x k rows

    def value(i: int, j: int) -> float | None:
        a, b = cell.get((i, j)), cell.get((j, i))
        if a is None or a["n"] < 2:
            return None
        va, vb = (r["q"] - r["s"] * r["s"] / r["n"] for r in (a, b))
        # what is left of equal values is rounding
        if va <= 1e-12 * a["q"] or vb <= 1e-12 * b["q"]:
            return None
        return 1.0 if i == j else (a["p"] - a["s"] * b["s"] / a["n"]) / math.sqrt(va * vb)

    cells = [(a, b, value(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    out = df.sparkSession.createDataFrame(cells, "var1 string, var2 string, value double")
    return out.select("var1", "var2", F.round("value", scale).alias("value"))


def describe(df: DataFrame, columns: Sequence[str], scale: int = 6) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max per column.
    Moments come from one aggregate; quantiles from one ranking of the long
    (column, value) table, so no column's values are gathered in one task."""
    stats = ["count", "mean", "std", "min", "max"]
    aggs = []
    for c in columns:
        aggs += [F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), F.max(c).cast("double")]
    row = df.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)])
    structs = []
    for j, c in enumerate(columns):
        for k, st in enumerate(stats):
            structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(st).alias("stat"),
                                    F.round(F.col(f"_{j * len(stats) + k}"), scale).alias("value")))
    moments = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]) \
        .unpivot([], list(columns), "column_name", "value")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column_name"], ["25%", "50%", "75%"])
    qlong = q.unpivot(["column_name"], ["25%", "50%", "75%"], "stat", "value") \
        .select("column_name", "stat", F.round("value", scale).alias("value"))
    return moments.unionByName(qlong)


def binned_scatter(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.floor(F.col(x) / x_width).cast("bigint").alias("x_bin"),
        F.floor(F.col(y) / y_width).cast("bigint").alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def order_by_median(df: DataFrame, key: str, value: str) -> DataFrame:
    from .windows import global_row_number
    m = exact_quantiles(df, value, [0.5], [key], ["median"])
    return global_row_number(m, ["median", key], "median_rank")


def kde_by_group(df: DataFrame, value: str, by: str | Sequence[str], points: int = 64, pad_bandwidths: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on an even grid of ``points`` values spanning
    [min - 3h, max + 3h], bandwidth h = sd * n^(-1/5) (Scott).

    The rows are first counted by group and value; a distinct value contributes once to every grid point of its group,
    weighted by its count, and the terms are summed map-side.  A group whose values are all equal (or a single one) has
    no bandwidth and no density: it is left out."""
    by = [by] if isinstance(by, str) else list(by)
    hist = value_histogram(df, value, by)
    mean = F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")
    stats = hist.groupBy(*by).agg(F.sum("_c").alias("_n"), mean.alias("_mean"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")) \
        .where(F.col("_lo") < F.col("_hi"))
    spread = join_nullsafe(hist, stats, by, "inner")
    stats = spread.groupBy(*by, "_n", "_lo", "_hi").agg(F.sum(F.col("_c") * F.pow(F.col("_v") - F.col("_mean"), 2)).alias("_ss"))
    stats = stats.withColumn("_h", F.sqrt(F.col("_ss") / (F.col("_n") - 1)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2))) \
        .withColumn("_g0", F.col("_lo") - pad_bandwidths * F.col("_h")) \
        .withColumn("_step", (F.col("_hi") + pad_bandwidths * F.col("_h") - F.col("_g0")) / (points - 1)) \
        .select(*by, "_n", "_h", "_g0", "_step")
    j = join_nullsafe(hist, stats, by, "inner")
    terms = j.select(*by, "_n", "_h", "_g0", "_step",
                     F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                                              lambda i: F.col("_c") * F.exp(-F.pow((F.col("_g0") + i * F.col("_step") - F.col("_v"))
                                                                                   / F.col("_h"), 2) / 2.0)))
                     .alias("grid_index", "k"))
    dens = terms.groupBy(*by, "grid_index", "_n", "_h", "_g0", "_step").agg(F.sum("k").alias("_s"))
    return dens.select(*by, F.col("grid_index").cast("bigint").alias("grid_index"),
                       F.round(F.col("_g0") + F.col("grid_index") * F.col("_step"), 6).alias("x"),
                       F.round(F.col("_s") / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))), 6)
                       .alias("density"))


def kde_by_feature(df: DataFrame, features: Sequence[str], by: str, points: int = 64) -> DataFrame:
    """``kde_by_group`` of every feature: one grouped job over the (feature, ``by``) pairs."""
    long = df.select(by, *[F.col(c).cast("double").alias(c) for c in features]).unpivot([by], list(features), "feature", "value")
    return kde_by_group(long, "value", ["feature", by], points)
