"""Property tests of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import knn as K
from tessera.operators import metrics as M
from tessera.operators.sampling import hash_rank, kfold, oversample, split_exact
from tessera.operators.spatial import clip_ring_convex, convex_hull, dissolve_outline
from tessera.operators.windows import global_ntile, global_row_number

from .conftest import SF_MID, SF_SMALL


def test_global_row_number_is_a_permutation_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    out = global_row_number(df, [F.col("k"), F.col("id")], name="rn", num_partitions=7).collect()
    ranks = sorted((r["k"], r["id"], r["rn"]) for r in out)
    assert [r[2] for r in ranks] == list(range(1, 5001))


@pytest.mark.parametrize("n", [1, 4, 5, 6, 23, 100])
def test_global_ntile_matches_sql_ntile(spark, n):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("v"))
    ours = {r["id"]: r["t"] for r in global_ntile(df, [F.col("v"), F.col("id")], 5, name="t").collect()}
    from tessera.operators import windows as Wn
    big = Wn.global_row_number(df, [F.col("v"), F.col("id")], name="_grn", with_total="_gn")
    distributed = {r["id"]: r["t"] for r in big.select("id", Wn.ntile_from_rank("_grn", "_gn", 5).alias("t")).collect()}
    assert distributed == ours
    df.createOrReplaceTempView("nt")
    ref = {r["id"]: r["t"] for r in spark.sql("SELECT id, ntile(5) OVER (ORDER BY v, id) AS t FROM nt").collect()}
    assert ours == ref


def test_split_sizes_exact_and_stable_under_repartition(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    a = split_exact(df, ["k"], 0.2, 42, strata=["g"], name="t")
    b = split_exact(df.repartition(13), ["k"], 0.2, 42, strata=["g"], name="t")
    ta = {r["k"] for r in a.where("t").collect()}
    tb = {r["k"] for r in b.where("t").collect()}
    assert ta == tb
    sizes = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count("*").alias("n")).collect()}
    got = {r["g"]: r["n"] for r in a.where("t").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {g: math.ceil(n * 0.2) for g, n in sizes.items()}


def test_hash_rank_dense_within_strata(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") < 1000, 0).otherwise(1).alias("g"))
    r = hash_rank(df, 7, ["k"], ["g"], name="r", size_name="n").collect()
    for g in (0, 1):
        rs = sorted(x["r"] for x in r if x["g"] == g)
        assert rs == list(range(1, len(rs) + 1))


def test_kfold_balanced(spark):
    df = spark.range(103).select(F.col("id").alias("k"))
    folds = [r["fold"] for r in kfold(df, ["k"], 5, 42).collect()]
    counts = sorted(folds.count(f) for f in range(5))
    assert counts == [20, 20, 21, 21, 21]


def test_oversample_equalises_classes(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") < 12).cast("int").alias("y"))
    out = oversample(df, "y", ["k"], 42)
    counts = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 38, 1: 38}
    originals = out.where(F.col("copy_index").isNull()).count()
    assert originals == 50


def test_confusion_matrix_golden_metrics(spark):
    # published confusion matrix (110, 21; 48, 108) -> accuracy 218/287
    rows = [Row(y=0, p=0)] * 110 + [Row(y=0, p=1)] * 21 + [Row(y=1, p=0)] * 48 + [Row(y=1, p=1)] * 108
    df = spark.createDataFrame(rows)
    acc = M.accuracy(df, "y", "p").first()["accuracy"]
    assert abs(acc - 218 / 287) < 1e-12
    cm = {r["actual"]: (r["pred_0"], r["pred_1"]) for r in M.confusion_matrix(df, "y", "p").collect()}
    assert cm == {0: (110, 21), 1: (48, 108)}
    rep = {r["class"]: r for r in M.classification_report(df, "y", "p").collect()}
    assert abs(rep["1"]["precision"] - 108 / 129) < 1e-12
    assert abs(rep["1"]["recall"] - 108 / 156) < 1e-12


def test_auc_perfect_and_constant(spark):
    perfect = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    const = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    assert M.roc_auc(perfect, "y", "s").first()["auc"] == 1.0
    assert M.roc_auc(const, "y", "s").first()["auc"] == 0.5


def test_point_in_concave_ring(spark):
    ring = [(0, 0), (800, 0), (800, 400), (400, 400), (400, 800), (0, 800), (0, 0)]
    pts = [(100, 100, True, True), (600, 600, False, False), (400, 600, False, True), (600, 400, False, True),
           (0, 0, False, True), (200, 799, True, True), (401, 401, False, False)]
    df = spark.createDataFrame([(x, y) for x, y, *_ in pts], "x long, y long")
    r = G.ring_of(*[(F.lit(a), F.lit(b)) for a, b in ring])
    out = df.select("x", "y", G.st_contains(r, "x", "y").alias("c"), G.st_anyinteract(r, "x", "y").alias("a")).collect()
    got = {(o["x"], o["y"]): (o["c"], o["a"]) for o in out}
    assert got == {(x, y): (c, a) for x, y, c, a in pts}


def test_convex_hull_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(int(x), int(y)) for x, y in rng.integers(0, 200, size=(300, 2))]
    df = spark.createDataFrame(pts, "x long, y long").repartition(5)
    hull = [(r["x"], r["y"]) for r in convex_hull(df, "x", "y").orderBy("vertex_index").collect()]
    assert set(hull) <= set((float(a), float(b)) for a, b in pts)
    n = len(hull)
    for i in range(n):
        (ax, ay), (bx, by) = hull[i], hull[(i + 1) % n]
        for px, py in pts:  # every point left of or on each counter-clockwise edge
            assert (bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0
    again = [(r["x"], r["y"]) for r in convex_hull(spark.createDataFrame(hull, "x double, y double"), "x", "y")
             .orderBy("vertex_index").collect()]
    assert again == hull


def test_clip_area_not_larger_than_inputs():
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    tri = [(5, -5), (15, 5), (5, 15), (5, -5)]
    clipped = clip_ring_convex(square, tri)

    def area(r):
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    assert 0 < area(clipped) <= min(area(square), area(tri))


def test_dissolve_cancels_shared_edge(spark):
    polys = spark.createDataFrame([(1,), (2,)], "id int").select(
        "id", F.when(F.col("id") == 1, G.ring_of((F.lit(0), F.lit(0)), (F.lit(10), F.lit(0)), (F.lit(10), F.lit(10)),
                                                 (F.lit(0), F.lit(10))))
        .otherwise(G.ring_of((F.lit(0), F.lit(10)), (F.lit(10), F.lit(10)), (F.lit(10), F.lit(20)),
                             (F.lit(0), F.lit(20)))).alias("ring"))
    segs = dissolve_outline(polys, "id").collect()
    assert len(segs) == 6  # 4 + 4 edges, the shared one removed from both


def brute_neighbours(ref, qry, k, ref_group=None, qry_group=None):
    """[(ids, squared distances)] per query, ties by id; distances summed feature by feature."""
    out = []
    for i, q in enumerate(qry):
        d = np.zeros(len(ref))
        for j in range(ref.shape[1]):
            d += (q[j] - ref[:, j]) ** 2
        if ref_group is not None:
            d = np.where(ref_group == qry_group[i], np.inf, d)
        order = np.lexsort((np.arange(len(ref)), d))[:k]
        out.append([(int(o), float(d[o])) for o in order if d[o] < np.inf])
    return out


def knn_frames(spark, ref, qry, ref_group=None, qry_group=None):
    names = [f"x{j}" for j in range(ref.shape[1])]
    ddl = "id long, y double, fold long, " + ", ".join(f"{n} double" for n in names)

    def frame(rows, groups):
        return spark.createDataFrame([(i, float(i % 2), None if groups is None else int(groups[i]), *map(float, r)) for i, r in enumerate(rows)], ddl)
    return frame(qry, qry_group), frame(ref, ref_group), names


@pytest.mark.parametrize("kind", ["normal", "tiny", "far from zero", "ties", "one place", "few rows"])
def test_knn_equals_bruteforce(spark, kind):
    rng = np.random.default_rng(5)
    ref, qry = rng.normal(size=(900, 3)), rng.normal(size=(70, 3)) * 2
    if kind == "tiny":
        ref, qry = ref * 1e-4, qry * 1e-4
    elif kind == "far from zero":
        ref, qry = ref * 1e-3 + 1e6, qry * 1e-3 + 1e6
    elif kind == "ties":
        ref, qry = np.round(ref), np.round(qry)
    elif kind == "one place":  # a third of all rows are copies of one
        ref[:300], qry[:20] = ref[0], ref[0]
    elif kind == "few rows":
        ref = ref[:4]
    q, r, names = knn_frames(spark, ref, qry)
    nb = K.knn_neighbours(q, r, names, 7, "id", ["id"], "y", cell_rows=40, block_rows=16, ref_block_rows=32).collect()
    got = {i: [] for i in range(len(qry))}
    for n in sorted(nb, key=lambda n: n["rank"]):
        got[n["id"]].append((n["ref_id"], n["dist"]))
    assert [got[i] for i in range(len(qry))] == brute_neighbours(ref, qry, 7)


def test_knn_candidates_stay_near_k_per_cell(spark):
    """Rows within 0..0.001 of each other: the tree still sends a query to few cells, and k rows come back from each."""
    rng = np.random.default_rng(6)
    ref, qry = rng.random((4000, 2)) * 1e-3, rng.random((50, 2)) * 1e-3
    run = K._nearest(2, 3)
    import pandas as pd
    side = [pd.DataFrame({"_side": s, "_q": np.arange(len(x)), "_bound": np.inf, "_g": s, "_f0": x[:, 0], "_f1": x[:, 1],
                          "_r0": np.arange(len(x)), "_r1": 0, "_y": 0.0}) for s, x in ((0, qry), (1, ref))]
    assert len(run(pd.concat(side))) == 150
    tree = K.Tree(ref, 100, 3)
    lo, hi = (np.array([f(ref[tree.home(ref) == c], axis=0) for c in range(tree.leaves)]) for f in (np.min, np.max))
    bound = np.array([n[-1][1] for n in brute_neighbours(ref, qry, 3)])
    rows, cells = tree.near(qry, bound, *tree.boxes(lo, hi))
    assert tree.leaves > 30 and len(rows) < 3 * len(qry)


def test_knn_rows_of_the_own_fold_are_no_neighbours(spark):
    rng = np.random.default_rng(7)
    x, fold = rng.normal(size=(500, 2)), rng.integers(0, 3, 500)
    fold[:200] = 1
    frame, _, names = knn_frames(spark, x, x, fold, fold)
    nb = K.knn_neighbours(frame, frame, names, 5, "id", ["id"], "y", group="fold", cell_rows=30, block_rows=64, ref_block_rows=32).collect()
    got = {i: [] for i in range(500)}
    for n in sorted(nb, key=lambda n: n["rank"]):
        got[n["id"]].append((n["ref_id"], n["dist"]))
    assert [got[i] for i in range(500)] == brute_neighbours(x, x, 5, fold, fold)


def test_knn_keeps_rows_with_missing_features_and_repeated_ids(spark):
    r = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)] + [(10, None, 99.0), (11, float("nan"), 99.0), (12, 0.0, None)], "id long, x double, y double")
    q = spark.createDataFrame([(1, 0.1), (1, 8.9), (2, None), (3, float("nan"))], "id long, x double")
    out = sorted((n["id"], n["prediction"]) for n in K.knn_regress(q, r, ["x"], 2, "id", ["id"], "y").collect() if n["prediction"] is not None)
    assert out == [(1, 0.5), (1, 8.5)]
    assert K.knn_regress(q, r, ["x"], 2, "id", ["id"], "y").where("prediction IS NULL").count() == 2
    assert K.knn_classify(q.limit(0), r, ["x"], 2, "id", ["id"], "y").collect() == []
    assert K.knn_regress(q, r.limit(0), ["x"], 2, "id", ["id"], "y").where("prediction IS NULL").count() == 4


def test_bias_lambda_zero_is_group_mean(spark):
    from tessera.operators import bias as B
    df = spark.createDataFrame([(1, 4.0), (1, 5.0), (2, 1.0), (2, 2.0), (2, 3.0)], "item long, rating double")
    m = B.fit(df, "rating", ["item"], [0.0, 2.0])
    mu = 3.0
    coef = {r["item"]: r["b_item"] for r in B.coefficients(m, "item", 0).collect()}
    assert coef == {1: 4.5 - mu, 2: 2.0 - mu}
    shrunk = {r["item"]: r["b_item"] for r in B.coefficients(m, "item", 1).collect()}
    assert abs(shrunk[1] - (3.0 / 4.0)) < 1e-12


def test_linear_regression_recovers_coefficients(spark):
    import __spark_entry__ as entry
    est = {r["term"]: r["estimate"] for r in entry.queries()["linreg"](spark, SF_SMALL).collect()}
    assert est == {"intercept": 2.0, "brightness": 0.003, "radiative_power": 0.02, "relative_humidity": -0.01,
                   "soil_water": 1.5}


def test_report_invariants(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    shares = q["report_brand_share"](spark, SF_SMALL).groupBy("year").agg(F.sum("percent_of_year_sales").alias("s"))
    for r in shares.collect():
        assert abs(r["s"] - 100.0) < 0.01 * 30
    cum = q["report_cumulative"](spark, SF_SMALL)
    tot = cum.groupBy("year").agg(F.sum("total_month_sales").alias("t"), F.max("cumulative_sales_by_year").alias("c"))
    for r in tot.collect():
        assert abs(r["t"] - r["c"]) < 1e-6


def test_boundary_points_split_the_predicates(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    strict = q["st_contains"](spark, SF_MID).count()
    closed = q["st_anyinteract"](spark, SF_MID).count()
    assert closed > strict


def test_results_stable_across_shuffle_partitions(spark):
    import __spark_entry__ as entry
    from tessera.testing import canonical
    q = entry.queries()["report_growth_quintile"]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        a = q(spark, SF_SMALL)
        ra = canonical(a.columns, [tuple(r) for r in a.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = q(spark, SF_SMALL)
    assert ra == canonical(b.columns, [tuple(r) for r in b.collect()])


def test_exact_quantiles_match_percentile(spark):
    from tessera.operators.profile import exact_quantiles
    rng = np.random.default_rng(11)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 2000), rng.normal(size=2000).round(2))]
    rows += [(None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    ours = {r["g"]: (r["a"], r["b"], r["c"]) for r in
            exact_quantiles(df, "v", [0.25, 0.5, 0.9], ["g"], ["a", "b", "c"]).collect()}
    ref = {r["g"]: tuple(r["p"]) for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.9]).alias("p")).collect()}
    assert ours.keys() == ref.keys()
    for g in ours:
        for x, y in zip(ours[g], ref[g]):
            assert abs(x - y) < 1e-12
    whole = exact_quantiles(df, "v", [0.5], names=["m"]).first()["m"]
    assert abs(whole - df.agg(F.percentile("v", 0.5)).first()[0]) < 1e-12


def test_first_per_key_with_a_hot_key(spark):
    from tessera.operators.cleaning import first_per_key
    df = spark.range(3000).select((F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 7 + 1)).alias("k"),
                                  F.col("id").alias("row_id"), (F.col("id") * 3).alias("v"))
    got = {r["k"]: (r["row_id"], r["v"]) for r in first_per_key(df, ["k"], ["row_id"]).collect()}
    ref = {r["k"]: (r["m"], r["m"] * 3) for r in df.groupBy("k").agg(F.min("row_id").alias("m")).collect()}
    assert got == ref


def test_oversample_copies_come_from_their_class(spark):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    out = oversample(df, "y", ["k"], 7)
    copies = out.where(F.col("copy_index").isNotNull())
    assert copies.where("y = 1 AND k % 5 <> 0").count() == 0
    assert sorted(r["copy_index"] for r in copies.collect()) == list(range(32 - 8))


def test_exact_quantiles_ranking_path(spark, monkeypatch):
    from tessera.operators import profile as P
    from tessera.operators import windows as Wn
    df = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000 / 10.0).alias("v"))
    ours = {r["g"]: (r["a"], r["b"]) for r in P.exact_quantiles(df, "v", [0.1, 0.75], ["g"], ["a", "b"]).collect()}
    ref = {r["g"]: tuple(r["p"]) for r in df.groupBy("g").agg(F.percentile("v", [0.1, 0.75]).alias("p")).collect()}
    for g in ref:
        assert all(abs(x - y) < 1e-12 for x, y in zip(ours[g], ref[g]))
    whole = P.exact_quantiles(df, "v", [0.3], names=["m"]).first()["m"]
    assert abs(whole - df.agg(F.percentile("v", 0.3)).first()[0]) < 1e-12


def test_global_cumsum_distributed_equals_window(spark):
    from pyspark.sql import Window
    from tessera.operators.windows import global_cumsum
    df = spark.range(3000).select(F.col("id"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    dist = {r["id"]: r["cum_v"] for r in global_cumsum(df, [F.col("id").desc()], ["v"]).collect()}
    w = Window.orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = {r["id"]: r["c"] for r in df.select("id", F.sum("v").over(w).alias("c")).collect()}
    assert dist == ref


def test_study_file_adapters(spark, tmp_path):
    from tessera.plans.deliveries import clean_deliveries
    from tessera.sources.study_files import DELIVERY_COLUMNS, read_deliveries_csv, read_ratings_files
    (tmp_path / "ratings.dat").write_text("1::10::4.0::838985046\n2::10::2.5::838983525\n1::11::5::838983392\n")
    (tmp_path / "movies.dat").write_text("10::GoldenEye (1995)::Action|Adventure\n11::No Year::Drama\n")
    ml = read_ratings_files(spark, str(tmp_path / "ratings.dat"), str(tmp_path / "movies.dat"))
    rows = {(r["userid"], r["movieid"]): r for r in ml.collect()}
    assert rows[(1, 10)]["year_publication"] == 1995 and rows[(1, 11)]["year_publication"] is None
    header = ",".join(f'"{c}"' for c, _, _ in DELIVERY_COLUMNS)
    line1 = "a1,P1,30,4.5,22.7,75.8,22.76,75.91,Snack,motorcycle,20,50,0,Sunny,,Low,#VALUE!,25"
    line2 = "a2,P2,31,4.6,22.7,75.8,22.76,75.91,Meal,scooter,21,51,0,Sunny,,High,3.5,#VALUE!"
    (tmp_path / "d.csv").write_text(header + "\n" + line1 + "\n" + line2 + "\n")
    raw = read_deliveries_csv(spark, str(tmp_path / "d.csv"))
    clean = clean_deliveries(raw).collect()
    assert len(clean) == 1 and clean[0]["id"] == "a1" and clean[0]["distance"] > 0


def test_ellipsoidal_distance_close_to_spherical(spark):
    # two points about 20 km apart near latitude 10: the ellipsoid differs by well under 0.5 %
    df = spark.createDataFrame([(-84000, 10000, -83850, 10100), (-84000, 10000, -84000, 10000)],
                               "x1 long, y1 long, x2 long, y2 long")
    r = df.select(G.haversine_km("x1", "y1", "x2", "y2").alias("s"),
                  G.andoyer_lambert_km("x1", "y1", "x2", "y2").alias("e")).collect()
    assert 15 < r[0]["s"] < 25 and abs(r[0]["e"] - r[0]["s"]) / r[0]["s"] < 0.005
    assert r[1]["e"] == 0.0


def test_fill_months_spine(spark):
    import __spark_entry__ as entry  # noqa: F401  (package import)
    from tessera.plans.reports import monthly_sales
    from tessera.plans.warehouse import load_star
    star = load_star(spark, SF_SMALL)
    plain = monthly_sales(star).count()
    filled = monthly_sales(star, fill_months=True)
    lo, hi = star.dim_time.agg(F.min("month_start"), F.max("month_start")).first()
    months = (hi.year - lo.year) * 12 + hi.month - lo.month + 1
    assert filled.count() == months >= plain


def test_bias_fill_unseen(spark):
    from tessera.operators import bias as B
    train = spark.createDataFrame([(1, 4.0), (2, 2.0)], "item long, rating double")
    test = spark.createDataFrame([(1, 4.0), (3, 3.0)], "item long, rating double")
    m = B.fit(train, "rating", ["item"])
    strict = {r["item"]: r["pred_l0"] for r in B.predict(m, test).collect()}
    filled = {r["item"]: r["pred_l0"] for r in B.predict(m, test, fill_unseen=True).collect()}
    assert strict == {1: 4.0, 3: None} and filled == {1: 4.0, 3: 3.0}


def test_correlation_of_pairs_with_missing_values(spark):
    from tessera.operators.profile import correlation_matrix
    rows = [(float(i), 2.0 * i if i % 4 else None, -1.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["var1"], r["var2"]): r["value"] for r in correlation_matrix(df, ["a", "b", "c"], 6).collect()}
    assert got["a", "b"] == got["b", "a"] == got["a", "a"] == 1.0 and got["b", "c"] == -1.0


def test_null_and_nan_are_both_missing(spark):
    from tessera.operators.profile import null_profile
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (None, "y")], "a double, b string")
    assert {r["column_name"]: r["null_count"] for r in null_profile(df).collect()} == {"a": 2, "b": 1}


def test_null_group_has_its_box_plot_and_density(spark):
    from tessera.operators.profile import boxplot_stats, kde_by_group
    df = spark.createDataFrame([(None if i % 2 else "g", float(i)) for i in range(40)], "g string, v double")
    assert {r["g"]: r["n"] for r in boxplot_stats(df, "v", ["g"]).collect()} == {None: 20, "g": 20}
    assert kde_by_group(df, "v", "g", points=8).where("g IS NULL").count() == 8


def test_deep_trees_are_refused(spark):
    from tessera.operators.models import decision_tree
    df = spark.createDataFrame([(0.0, 0), (1.0, 1)], "x double, y int")
    with pytest.raises(ValueError):
        decision_tree(df, ["x"], "y", max_depth=31)


def test_delimited_file_keeps_missing_fields(spark, tmp_path):
    from pyspark.sql import types as T
    from tessera.sources.readers import read_delimited, write_delimited
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in "abc"])
    for sep in ("::", "|", "$^"):
        path = f"{tmp_path}/{len(sep)}{ord(sep[0])}"
        write_delimited(spark.createDataFrame([(1, None, 3), (None, 2, None)], schema), path, sep)
        assert sorted(map(str, (tuple(r) for r in read_delimited(spark, path, schema, sep).collect()))) \
            == ["(1, None, 3)", "(None, 2, None)"]


def test_averages_of_refunds_round_like_sales(spark):
    from tessera.plans.reports import exact_avg
    df = spark.sql("SELECT CAST(t AS DECIMAL(20,4)) AS t, 2 AS n FROM VALUES (-1.01), (1.01), (0.0) AS v(t)")
    assert sorted(r[0] for r in df.select(exact_avg("t", "n")).collect()) == [-0.51, 0.0, 0.51]


def test_pairs_across_the_180th_meridian(spark):
    from tessera.operators.spatial import within_distance_points
    a = spark.createDataFrame([(1, 179_990, 0), (2, -179_980, 0)], "a bigint, ax int, ay int")
    b = spark.createDataFrame([(7, -179_990, 0), (8, 179_970, 0)], "b bigint, bx int, by_ int")
    got = {(r["a"], r["b"]) for r in within_distance_points(a, b, 5.0, "ax", "ay", "bx", "by_").collect()}
    assert got == {(1, 7), (1, 8), (2, 7)}  # 2 and 8 are 5.6 km apart


def test_confusion_matrix_has_a_row_for_every_class(spark):
    from tessera.operators.metrics import confusion_matrix
    df = spark.createDataFrame([(0, 0), (0, 1)], "y int, p int")
    assert sorted(tuple(r) for r in confusion_matrix(df, "y", "p").collect()) == [(0, 1, 1), (1, 0, 0)]


def test_caller_settings_come_back(spark):
    import tessera.plans.registry as registry
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        registry.queries()["scan_table"](spark, SF_SMALL)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_changed_input_is_loaded_anew(spark, tmp_path):
    from tessera.session import folder_state
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    first = folder_state(spark, str(tmp_path))
    assert folder_state(spark, str(tmp_path)) == first
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert folder_state(spark, str(tmp_path)) != first


def test_histogram_by_bin_width(spark):
    from tessera.operators.profile import histogram
    df = spark.createDataFrame([(v,) for v in (1.0, 2.5, 2.9, 7.0, None)], "v double")
    got = [(r["bin_lo"], r["bin_hi"], r["n"]) for r in histogram(df, "v", binwidth=2.5).orderBy("bin").collect()]
    assert got == [(0.0, 2.5, 1), (2.5, 5.0, 2), (5.0, 7.5, 1)]


def test_densities_of_every_feature(spark):
    from tessera.plans import registry
    rows = registry.queries()["kde_by_feature"](spark, SF_SMALL).collect()
    one = {(r.quality, r.grid_index): (r.x, r.density) for r in registry.queries()["kde_by_group"](spark, SF_SMALL).collect()}
    assert {r.feature for r in rows} == {f"f{i}" for i in range(1, 12)} and len(rows) == 11 * len(one)
    assert {(r.quality, r.grid_index): (r.x, r.density) for r in rows if r.feature == "f11"} == one


def random_rings(seed, n=25, size=3000):
    """Concave integer rings (stars around a centre), one with a repeated vertex, one a line, in either direction."""
    rng = np.random.default_rng(seed)
    rings = []
    for i in range(n):
        cx, cy, k = *rng.integers(-2000, 2000, 2), int(rng.integers(3, 40))
        angle = np.sort(rng.random(k) * 2 * np.pi)
        radius = rng.integers(1, size, k)
        pts = [(int(cx + r * np.cos(t)), int(cy + r * np.sin(t))) for r, t in zip(radius, angle)]
        if i % 5 == 0:  # on grid lines
            pts = [(100 * round(x / 100), 100 * round(y / 100)) for x, y in pts]
        if i % 7 == 0:
            pts.insert(1, pts[0])
        if i % 2:
            pts.reverse()
        rings.append([*pts, pts[0]])
    rings += [[(0, 0), (700, 0), (0, 0)], [(-2000, -2000), (2000, -2000), (2000, 2000), (-2000, 2000), (-2000, -2000)]]
    return rings


RINGS = "id long, ring array<struct<x:bigint,y:bigint>>"


@pytest.mark.parametrize("seed,cell", [(1, 100), (2, 500), (3, 7), (4, 20_000)])
def test_edge_index_equals_whole_rings(spark, seed, cell):
    from tessera.operators import spatial as S
    rings = random_rings(seed, 12 if cell < 50 else 25, 400 if cell < 50 else 3000)
    rng = np.random.default_rng(seed)
    places = [(int(x), int(y)) for x, y in rng.integers(-4000, 4000, (250, 2))] + [p for r in rings for p in r[:4]] \
        + [((a[0] + b[0]) // 2, (a[1] + b[1]) // 2) for r in rings for a, b in zip(r, r[1:])] + [(100 * int(x), 100 * int(y)) for x, y in rng.integers(-30, 30, (80, 2))]
    polys = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)], RINGS)
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(-1, None, 5)], "pid long, x_md long, y_md long").cache()
    pairs = points.crossJoin(polys)
    inside = {(r["id"], r["pid"]) for r in pairs.where(G.st_contains("ring", "x_md", "y_md")).select("id", "pid").collect()}
    touched = {(r["id"], r["pid"]) for r in pairs.where(G.st_anyinteract("ring", "x_md", "y_md")).select("id", "pid").collect()}
    for strict, expected in ((True, inside), (False, touched)):
        got = S.contains_join(polys, points, strict=strict, cell=cell).select("id", "pid").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected
        out = {r["pid"] for r in S.outside_all(polys, points, "pid", strict=strict, cell=cell).collect()}
        assert out == {r["pid"] for r in points.collect()} - {p for _, p in expected}
    assert len(touched) > len(inside) > 50


def test_edge_index_carries_edges_not_rings(spark):
    """A ring of 4,000 vertices: no row of the index holds more than the edges of its cell."""
    from tessera.operators import spatial as S
    ring = [(int(50_000 * np.cos(t) * (1 + 0.2 * np.sin(40 * t))), int(50_000 * np.sin(t) * (1 + 0.2 * np.sin(40 * t)))) for t in np.linspace(0, 2 * np.pi, 4000)]
    polys = spark.createDataFrame([(0, [{"x": x, "y": y} for x, y in [*ring[:-1], ring[0]]])], "_pid long, ring array<struct<x:bigint,y:bigint>>")
    index = S.edge_index(polys)
    held = index.selectExpr("max(size(_edges))", "sum(size(_edges))", "count(*)").first()
    assert held[0] < 60 and held[1] < 4 * 4000 and held[2] > 20_000


def geodesic_brute(px, py, ax, ay, bx, by):
    """Smallest Andoyer-Lambert distance over many places of the edge's arc on the auxiliary sphere."""
    f = 1 / 298.257223563
    red = lambda y: np.arctan((1 - f) * np.tan(np.radians(y / 1000)))
    vec = lambda lon, b: np.array([np.cos(b) * np.cos(lon), np.cos(b) * np.sin(lon), np.sin(b)])
    a, b = vec(np.radians(ax / 1000), red(ay)), vec(np.radians(bx / 1000), red(by))
    t = np.linspace(0, 1, 20_001)[:, None]
    v = a * (1 - t) + b * t
    v /= np.linalg.norm(v, axis=1)[:, None]
    b1, b2, dl = np.arcsin(v[:, 2]), red(py), np.arctan2(v[:, 1], v[:, 0]) - np.radians(px / 1000)
    s = 2 * np.arcsin(np.sqrt(np.sin((b1 - b2) / 2) ** 2 + np.cos(b1) * np.cos(b2) * np.sin(dl / 2) ** 2))
    s = np.maximum(s, 1e-12)
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - np.sin(s)) * (np.sin(p) * np.cos(q)) ** 2 / np.cos(s / 2) ** 2
    y = (s + np.sin(s)) * (np.cos(p) * np.sin(q)) ** 2 / np.sin(s / 2) ** 2
    return float((6378.137 * (s - f / 2 * (x + y))).min())


def test_geodesic_edge_distance(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        x, y = int(rng.integers(-170_000, 170_000)), int(rng.integers(-75_000, 75_000))
        d = rng.integers(-400, 400, 6)
        rows.append((x, y, *(float(v) for v in (x + d[0], y + d[1], x + d[2], y + d[3]))))
    rows += [(0, 0, 0.0, 100.0, 0.0, 100.0), (10, 0, 0.0, 0.0, 111.0, 0.0), (0, 60_000, -200.0, 60_000.0, 200.0, 60_000.0)]
    df = spark.createDataFrame(rows, "px long, py long, ax double, ay double, bx double, by double")
    got = df.select(G.geodesic_edge_km(F.struct("ax", "ay", "bx", "by"), "px", "py").alias("d")).collect()
    for r, row in zip(got, rows):
        assert abs(r["d"] - geodesic_brute(*row)) < 2e-3, row  # a milli-degree is about 0.1 km
    # published lengths: a degree of longitude on the equator, a degree of latitude from it
    deg = spark.createDataFrame([(0, 0, 1000.0, 0.0, 1000.0, 0.0), (0, 0, 0.0, 1000.0, 0.0, 1000.0)], df.schema)
    assert [round(r[0], 3) for r in deg.select(G.geodesic_edge_km(F.struct("ax", "ay", "bx", "by"), "px", "py")).collect()] == [111.319, 110.574]


@pytest.mark.parametrize("ellipsoidal", [False, True])
def test_distance_to_polygons_meets_every_near_edge(spark, ellipsoidal):
    from tessera.operators import spatial as S
    rings = random_rings(9, 8)
    places = [(int(x), int(y)) for x, y in np.random.default_rng(9).integers(-5000, 5000, (150, 2))]
    polys = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)], RINGS)
    points = spark.createDataFrame([(i % 140, *p) for i, p in enumerate(places)], "pid long, x_md long, y_md long")  # ids repeat
    edges = spark.createDataFrame([tuple(map(float, (*a, *b))) for r in rings for a, b in zip(r, r[1:]) if a != b], "ax double, ay double, bx double, by double")
    measure = G.geodesic_edge_km if ellipsoidal else G.planar_edge_km
    far = points.distinct().crossJoin(edges).groupBy("pid", "x_md", "y_md").agg(F.min(measure(F.struct("ax", "ay", "bx", "by"), "x_md", "y_md")).alias("d")).collect()
    touched = {r["pid"] * 10**6 + r["x_md"] for r in points.crossJoin(polys).where(G.st_anyinteract("ring", "x_md", "y_md")).collect()}
    expected = {(r["pid"], r["x_md"]): 0.0 if r["pid"] * 10**6 + r["x_md"] in touched else r["d"] for r in far}
    got = S.within_distance_polygons(polys, points, 40.0, ellipsoidal=ellipsoidal, cell=300).collect()
    assert {(r["pid"], r["x_md"]): round(r["distance_km"], 9) for r in got} == {k: round(d, 9) for k, d in expected.items() if d <= 40}
    assert len(got) == sum(expected[i % 140, p[0]] <= 40 for i, p in enumerate(places))


def test_least_squares_equals_numpy_and_drops_aliased_terms(spark):
    from tessera.operators.linear import dummy_columns, least_squares, levels_of, student_p
    rng = np.random.default_rng(11)
    rows = [(int(i), "abc"[int(rng.integers(3))], float(rng.normal()), float(rng.normal())) for i in range(400)]
    rows = [(i, g, x, 2 * x, 3 + 2 * x + {"a": 0.0, "b": 1.0, "c": -2.0}[g] + e) for i, g, x, e in rows] + [(900, None, 1.0, 2.0, 5.0), (901, "a", None, 1.0, 5.0), (902, "a", 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, g string, x double, twice double, y double")
    coded, names = dummy_columns(df, levels_of(df, ["g"]))
    assert names == ["g_b", "g_c"]
    fit = least_squares(coded, [*names, "x", "twice"], "y")
    whole = [r for r in rows if None not in r]
    X = np.array([[1, r[1] == "b", r[1] == "c", r[2]] for r in whole], float)
    y = np.array([r[4] for r in whole])
    beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    errors = np.sqrt(rss[0] / (len(y) - 4) * np.diag(np.linalg.inv(X.T @ X)))
    assert np.allclose(fit.estimates[:4], beta) and np.allclose(fit.std_errors[:4], errors) and fit.estimates[4] is None
    assert (fit.rows, fit.rank, fit.df) == (400, 4, 396)
    # two-sided p-values from tables of the t distribution
    assert [round(student_p(t, d), 4) for t, d in ((2.228, 10), (1.96, 1e6), (0.0, 5), (12.706, 1), (2.0, 60))] == [0.05, 0.05, 1.0, 0.05, 0.05]


def test_dummy_encode_levels(spark):
    from tessera.operators.models import dummy_encode
    df = spark.createDataFrame([(1, "b", 2), (2, "a", 1), (3, None, 1), (4, "c d", 2)], "id int, g string, n int")
    out = dummy_encode(df, ["g", "n"]).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "b", 2, 1, 0, 1), (2, "a", 1, 0, 0, 0), (4, "c d", 2, 0, 1, 1)]
    assert out[0].__fields__ == ["id", "g", "n", "g_b", "g_c d", "n_2"]


def test_bagged_grid_equals_drawing_every_sample(spark):
    """Every point of the grid against samples drawn one by one; short lists are searched again."""
    from tessera.operators import bagging as B
    rng = np.random.default_rng(13)
    n = 90
    x, fold = rng.normal(size=(n, 3)), rng.integers(0, 3, n)
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=n)
    grid = B.BagGrid(("x0", "x1", "x2"), (2, 5), (0.5, 1.0), (0.4, 1.0), (1, 4), seed=9)
    frame = spark.createDataFrame([(i, *map(float, r), float(t), int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold))], "id long, x0 double, x1 double, x2 double, y double, fold int")
    expected = np.zeros((n, len(grid.points())))
    for p, (estimators, share, feature_share, k) in enumerate(grid.points()):
        for q in range(n):
            values = []
            for e in range(estimators):
                cols = [int(f[1]) for f in grid.drawn_features(e, feature_share)]
                count = B.times_drawn(B.draws(np.arange(n), np.array([e]), 9)[:, 0], share) * (fold != fold[q])
                d = ((x[:, cols] - x[q, cols]) ** 2).sum(axis=1)
                sample = [y[i] for i in np.lexsort((np.arange(n), d)) for _ in range(count[i])][:k]
                values.append(np.mean(sample))
            expected[q, p] = np.mean(values)
    got = B.bagged_predictions(frame, frame, grid, "id", "y", group="fold", depth=5).collect()
    assert sorted(r["id"] for r in got) == list(range(n))
    assert np.allclose([r["preds"] for r in sorted(got, key=lambda r: r["id"])], expected)
    table = {(r["n_estimators"], r["max_samples"], r["max_features"], r["n_neighbors"]): r["r2"] for r in B.bagged_cv_grid(frame, grid, "id", "y", "fold", depth=200).collect()}
    for p, point in enumerate(grid.points()):
        r2 = [1 - ((y[fold == f] - expected[fold == f, p]) ** 2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum() for f in range(3)]
        assert abs(table[point] - np.mean(r2)) < 1e-9
    # the draws are Poisson numbers
    u = B.draws(np.arange(20_000), np.arange(3), 1)
    assert abs(B.times_drawn(u, 0.7).mean() - 0.7) < 0.02 and abs(B.times_drawn(u, 0.7).var() - 0.7) < 0.03


def test_best_fold_scores_are_those_of_the_out_of_fold_table(spark):
    from tessera.operators import folds as CV
    rows = [(i, i % 3, float(i % 7), int(i % 7 > 3) if i % 11 else 0) for i in range(90)]
    train = spark.createDataFrame(rows, "id long, fold int, x double, y int")
    fit = lambda df: df.agg(F.avg("x")).first()[0]
    predict = lambda m, df: df.select("id", "y", (F.col("x") > m).cast("int").alias("prediction"))
    models, oof = CV.out_of_fold(train, "fold", 3, fit, predict)
    by = {f: [r for r in rows if r[1] == f] for f in range(3)}
    for f in range(3):
        assert abs(models[f] - np.mean([r[2] for r in rows if r[1] != f])) < 1e-12
    accuracy = {f: np.mean([int(r[2] > models[f]) == r[3] for r in by[f]]) for f in range(3)}
    assert {r["fold"]: r["accuracy"] for r in CV.fold_accuracy(oof, "fold", "y").collect()} == pytest.approx(accuracy)
    table = {r["fold"]: r for r in CV.best_fold(train, train, "fold", 3, "y", fit, predict).collect()}
    best = max(accuracy, key=lambda f: (accuracy[f], -f))
    assert [f for f, r in table.items() if r["best"]] == [best] and oof.count() == 90
    assert table[0]["mean_accuracy"] == pytest.approx(np.mean(list(accuracy.values()))) and table[0]["sd_accuracy"] == pytest.approx(np.std(list(accuracy.values())))
    assert table[best]["test_accuracy"] == pytest.approx(np.mean([int(r[2] > models[best]) == r[3] for r in rows]))


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_split_by_selection_equals_ranking(spark, digits):
    df = spark.range(3000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 3 * (F.col("id") % 2)).cast("string")).alias("g"), (F.col("id") * 7).alias("x"))
    for strata, fraction in (((), 0.2), (("g",), 0.37), (("g",), 0.0), ((), 1.0)):
        got = split_exact(df, ["id"], fraction, 5, strata, name="t", digits=digits)
        ranked = hash_rank(df, 5, ["id"], strata, name="r", size_name="n").where(F.col("r") <= F.ceil(F.col("n") * F.lit(fraction)))
        assert {r["id"] for r in got.where("t").collect()} == {r["id"] for r in ranked.collect()}
        assert got.columns == [*df.columns, "t"] and got.count() == 3000
    assert split_exact(df.limit(0), ["id"], 0.5, 5).collect() == []


def test_split_does_not_shuffle_whole_rows(spark):
    from .test_plans import _plan as plan_of
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.lit("wide").alias("text"))
    for strata in ((), ("g",)):
        plan = plan_of(split_exact(df, ["id"], 0.2, 5, strata))
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_histogram_by_group_and_by_width(spark):
    from tessera.operators import profile as P
    df = spark.createDataFrame([("a", 0.0), ("a", 9.9), ("b", 5.0), (None, 10.0), ("b", None)], "g string, v double")
    out = {(r["g"], r["bin"]): r["n"] for r in P.histogram(df, "v", 2, by=["g"]).collect()}
    assert out == {("a", 0): 1, ("a", 1): 1, ("b", 0): 0, ("b", 1): 1, (None, 0): 0, (None, 1): 1}
    wide = P.histogram(df, "v", binwidth=4.0).orderBy("bin").collect()
    assert [(r["bin"], r["bin_lo"], r["bin_hi"], r["n"]) for r in wide] == [(0, 0.0, 4.0, 1), (1, 4.0, 8.0, 1), (2, 8.0, 12.0, 2)]


def test_density_leaves_out_constant_groups(spark):
    from tessera.operators import profile as P
    df = spark.createDataFrame([("c", 3.0)] * 5 + [("one", 1.0)] + [("x", float(i % 4)) for i in range(40)] + [("x", None)], "g string, v double")
    rows = P.kde_by_group(df, "v", "g", 16).orderBy("grid_index").collect()
    assert {r["g"] for r in rows} == {"x"} and len(rows) == 16
    v = np.array([i % 4 for i in range(40)], float)
    h = v.std(ddof=1) * 40 ** -0.2
    for r in rows:
        x = v.min() - 3 * h + r["grid_index"] * (v.max() - v.min() + 6 * h) / 15
        assert abs(r["density"] - np.exp(-((x - v) / h) ** 2 / 2).sum() / (40 * h * np.sqrt(2 * np.pi))) < 2e-6


def test_correlations_of_pairs_in_one_pass(spark):
    from tessera.operators import profile as P
    rng = np.random.default_rng(21)
    x = rng.normal(size=(500, 4)) * [1, 1e-3, 50, 1] + [1e6, 5, 0, 7]
    x[:, 2] += 20 * (x[:, 0] - 1e6)
    x[rng.random((500, 4)) < 0.2] = np.nan
    x[:, 3] = 7.25
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double").repartition(5)
    got = {(r["var1"], r["var2"]): r["value"] for r in P.correlation_matrix(df, list("abcd"), 6).collect()}
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            expected = None if "d" in (a, b) else float(np.corrcoef(x[both, i], x[both, j])[0, 1])
            assert got[a, b] == expected or abs(got[a, b] - expected) < 2e-6, (a, b)
