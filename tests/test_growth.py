"""Steps that must not grow faster than their input: what is shuffled, written or computed again."""

import glob
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import SF_SMALL


def plain_biases(rows, factors, lam):
    """[{key: bias} per factor] of rows (label, *keys), stage by stage; rows without a label are counted, not summed."""
    known = [r for r in rows if r[0] is not None]
    mu = sum(r[0] for r in known) / len(known)
    tables = []
    for j in range(len(factors)):
        sums, n = {}, {}
        for r in rows:
            k = r[1 + j]
            n[k] = n.get(k, 0) + 1
            if r[0] is not None:
                sums[k] = sums.get(k, 0.0) + r[0] - mu - sum(t[r[1 + i]] for i, t in enumerate(tables))
        tables.append({k: sums[k] / (n[k] + lam) if k in sums else None for k in n})
    return tables


@pytest.mark.parametrize("few", [0, 20, 1 << 18])
def test_bias_tables_however_many_keys(spark, few, monkeypatch):
    from tessera.operators import bias as B
    monkeypatch.setattr(B, "FEW_SUMS", few)
    factors = ["item", "user", "genre", "year"]
    rows = [(None if i == 7 else float(i * 7 % 11), i % 5, i * 3 % 13, f"g{i % 4}", None if i % 6 == 0 else i % 6) for i in range(120)]
    df = spark.createDataFrame(rows, "rating double, item long, user long, genre string, year int").repartition(5)
    lambdas = [0.0, 0.5, 3.0]
    model = B.fit(df, "rating", factors, lambdas)
    assert len(model.tables["item"].columns) == 3  # no column per lambda
    for i, lam in enumerate(lambdas):
        for f, expected in zip(factors, plain_biases(rows, factors, lam)):
            got = {r[f]: r[f"b_{f}"] for r in B.coefficients(model, f, i).collect()}
            assert got.keys() == expected.keys()
            assert all(math.isclose(got[k], expected[k], abs_tol=1e-9) for k in got)


def test_rows_meet_absent_keys_only(spark):
    from tessera.operators.joins import flag_unmatched, semi_join_all
    rows = [(i, None if i % 9 == 0 else i % 7, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    other = spark.createDataFrame([(1, 0), (2, 1), (2, None), (4, 4), (None, 4)], "a long, b long")
    others = [(other, "a"), (other, "b")]
    flagged = flag_unmatched(df, others, "gone")
    kept = {r["id"] for r in semi_join_all(df, others).collect()}
    assert {r["id"] for r in flagged.where(~F.col("gone")).collect()} == kept and flagged.count() == 60
    assert 0 < len(kept) < 60


def test_orphans_are_counted_by_key(spark):
    from tessera.operators.joins import fk_audit
    fact = spark.createDataFrame([(1,), (1,), (5,), (5,), (6,), (None,)], "k long")
    dim = spark.createDataFrame([(1,), (2,)], "id long")
    audit = fk_audit(fact, "k", dim, "id")
    assert audit.collect()[0].asDict() == {"fk_column": "k", "orphan_rows": 4, "orphan_keys": 2}
    assert fk_audit(fact.limit(0), "k", dim, "id").collect()[0].asDict() == {"fk_column": "k", "orphan_rows": 0, "orphan_keys": 0}
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [k" in plan[plan.index("Join LeftAnti"):], plan


@pytest.mark.parametrize("key", ["fk_audit", "join_expr_key", "join_fanout_audit"])
def test_sales_are_read_from_the_written_table(spark, key):
    import __spark_entry__ as entry
    df = entry.queries()[key](spark, SF_SMALL)
    assert not [f for f in df.inputFiles() if "lineitem" in f]


def test_split_of_deliveries_parses_the_raw_text_once(spark):
    from tessera.plans.delivery_models import delivery_sets
    from tessera.session import scratch_path
    delivery_sets(spark, SF_SMALL)
    assert glob.glob(scratch_path(spark, "deliveries-*", "rows", "*.parquet"))


def test_write_settings_are_back_afterwards(spark):
    from tessera.session import WRITE_CONF, unsorted_writes
    before = {k: spark.conf.get(k, None) for k in WRITE_CONF}
    with unsorted_writes(spark):
        with unsorted_writes(spark):
            pass
        assert {k: spark.conf.get(k) for k in WRITE_CONF} == WRITE_CONF
    assert {k: spark.conf.get(k, None) for k in WRITE_CONF} == before


def test_draws_by_few_steps():
    from tessera.operators.bagging import times_drawn
    uniform = np.concatenate([np.random.default_rng(3).random(5000), [0.0, 1 - 2.0 ** -40, 0.9999, math.exp(-0.5)]])
    for share in (0.5, 0.7, 1.0):
        p, total = math.exp(-share), 0.0
        expected = np.zeros(len(uniform), int)
        for k in range(1, 20):
            total += p
            expected += uniform >= total
            p *= share / k
        assert (times_drawn(uniform, share) == expected).all() and expected.max() > 5


def test_home_rows_of_whole_cells_are_not_ranked_again(spark, monkeypatch):
    from tessera.operators import knn as K
    calls = []
    best = K._best
    monkeypatch.setattr(K, "_best", lambda found, k: calls.append(k) or best(found, k))
    rows = [(i, float(i * 37 % 101), float(i * 53 % 97), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    near = K.knn_neighbours(df, df, ["x", "y"], 4, "id", ["id"], "z", cell_rows=40)
    assert near.count() == 1200 and calls == [4]


def knn_frame(spark, n, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, *map(float, rng.normal(size=3)), float(rng.normal()), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, label double, fold int")


def test_neighbours_are_not_written(spark):
    from tessera.operators import knn as K
    from tessera.session import scratch_path
    df = knn_frame(spark, 400)
    before = set(glob.glob(scratch_path(spark, "*")))
    means = K.knn_regress(df, df, ["x", "y", "z"], 9, "id", ["id"], "label", cell_rows=60, block_rows=50)
    assert means.where("prediction IS NOT NULL").count() == 400
    assert K.knn_cv_predictions(df, ["x", "y"], "label", ["id"], [2, 5], "fold", cell_rows=60).count() == 400
    assert set(glob.glob(scratch_path(spark, "*"))) == before


def test_means_of_neighbours_that_stand_at_several_blocks(spark):
    """Blocks and chunks of a few rows, repeated points, a group without neighbours of its own: as without any blocks."""
    from tessera.operators import knn as K
    rng = np.random.default_rng(8)
    x, y, fold = np.round(rng.normal(size=(500, 2)), 1), rng.normal(size=500), rng.integers(0, 4, 500)
    x[:120], fold[:120] = x[0], 2
    df = spark.createDataFrame([(i, *map(float, p), float(t), int(f)) for i, (p, t, f) in enumerate(zip(x, y, fold))], "id long, x double, y double, label double, fold int")
    got = {r["id"]: (r["p3"], r["p11"]) for r in K.knn_cv_predictions(df, ["x", "y"], "label", ["id"], [3, 11], "fold", cell_rows=40, block_rows=20, ref_block_rows=64).collect()}
    for i in range(500):
        d = np.where(fold == fold[i], np.inf, ((x - x[i]) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(500), d))
        assert np.allclose(got[i], [y[order[:3]].mean(), y[order[:11]].mean()])


def test_bagging_writes_no_neighbours(spark, monkeypatch):
    from tessera.operators import bagging as B
    written = {}

    def counted(df, prefix="tbl", f=B.materialize):
        out = f(df, prefix)
        written[prefix] = written.get(prefix, 0) + out.count()
        return out
    monkeypatch.setattr(B, "materialize", counted)
    grid = B.BagGrid(("x", "y", "z"), (2, 4), (0.5, 1.0), (0.4, 1.0), (1, 3), seed=5)
    assert B.bagged_cv_grid(knn_frame(spark, 150), grid, "id", "label", "fold").count() == 16
    # squared errors of 16 points and 3 folds from each of a few tasks; neither neighbours nor predictions of the 150 rows
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert set(written) == {"bag-scored"} and written["bag-scored"] <= 16 * 3 * tasks


def test_walk_equals_counting_row_by_row():
    from tessera.operators import bagging as B
    from tessera.operators.knn import Near
    rng = np.random.default_rng(6)
    grid, rows, depth = B.BagGrid(("a",), (2, 5), (0.5, 1.0), (1.0,), (1, 4, 6), seed=3), 150, 12
    have = rng.integers(0, depth + 1, rows)
    near = Near(have, np.zeros((rows, depth)), rng.integers(0, 40, (rows, depth)), rng.normal(size=(rows, depth)))
    estimators = np.arange(5)
    sums, known, enough = B._walk(near, estimators, [estimators], grid)
    for q in range(rows):
        for s, share in enumerate(grid.shares):
            count = B.times_drawn(B.draws(near.ids[q], estimators, 3), share)[:have[q]]
            for i, k in enumerate(grid.ks):
                drawn = [[v for v, n in zip(near.y[q], count[:, e]) for _ in range(n)] for e in estimators]
                for step, part in enumerate((range(2), range(2, 5))):
                    means = [np.mean(drawn[e][:k]) for e in part if drawn[e]]
                    assert math.isclose(sums[q, 0, s, i, step], sum(means), abs_tol=1e-9) and known[q, 0, s, i, step] == len(means)
        assert enough[q] == all((B.times_drawn(B.draws(near.ids[q], estimators, 3), share)[:have[q]].sum(axis=0) >= 6).all() for share in grid.shares)
    numbers = rng.normal(size=(7, 5)) * 10.0 ** rng.integers(-3, 4, (7, 5))
    assert (B._unpacked(B._packed(numbers), 5) == numbers).all() and B._unpacked(B._packed(numbers[:0]), 5).shape == (0, 5)


def test_errors_are_told_on_training_and_test_rows(spark):
    import __spark_entry__ as entry
    from tessera.plans.modeling import FIRE_FEATURES, fire_sets
    got = {(r["model"], r["split"]): r for r in entry.queries()["metric_regression"](spark, SF_SMALL).collect()}
    assert set(got) == {(m, s) for m in ("knn", "linear_regression") for s in ("test", "train")}
    sets = fire_sets(spark, SF_SMALL)
    x, y = (np.array([[float(v) for v in r] for r in sets.train.orderBy("row_id").select(*c).collect()]) for c in (FIRE_FEATURES, ["fire_area"]))
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :15]
    error = y[:, 0] - y[near, 0].mean(axis=1)
    assert math.isclose(got["knn", "train"]["mae"], np.abs(error).mean(), abs_tol=1e-4) and got["knn", "train"]["n"] == len(y)
    design = np.column_stack([np.ones(len(x)), x])
    residual = y[:, 0] - design @ np.linalg.lstsq(design, y[:, 0], rcond=None)[0]
    assert math.isclose(got["linear_regression", "train"]["rmse"], np.sqrt((residual ** 2).mean()), abs_tol=1e-4)
    assert got["knn", "test"]["n"] == sets.test.count()


def test_folds_are_ranked_once_for_all_fits(spark, monkeypatch):
    import __spark_entry__ as entry
    from tessera.operators import models as ML
    kept = []
    search = ML.grid_search
    monkeypatch.setattr(ML, "grid_search", lambda train, *a, **kw: kept.append((train, train.storageLevel.useDisk)) or search(train, *a, **kw))
    assert entry.queries()["grid_search"](spark, SF_SMALL).count() == 7
    assert kept[0][1] and not kept[0][0].is_cached


def test_leaderboard_writes_no_neighbours(spark):
    import __spark_entry__ as entry
    from tessera.session import scratch_path
    before = set(glob.glob(scratch_path(spark, "*")))
    assert entry.queries()["model_leaderboard"](spark, SF_SMALL).count() == 5
    made = {f.rsplit("/", 1)[1].split("-")[0] + "-" + f.rsplit("/", 1)[1].split("-")[1] for f in set(glob.glob(scratch_path(spark, "*"))) - before}
    assert not made & {"knn-home", "knn-visits", "knn-reference", "knn-queries", "bag-near"}


def test_far_rows_reach_every_block_once(spark):
    """Eleven features, where no cell can be left out: the rows a block reads do not grow with the neighbours asked for."""
    from tessera.operators import knn as K
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(600, 11)), rng.integers(0, 2, 600)
    names = [f"x{j}" for j in range(11)]
    df = spark.createDataFrame([(i, *map(float, p), int(t)) for i, (p, t) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{n} double" for n in names) + ", y int")
    votes = {r["id"]: r["probability"] for r in K.knn_classify(df, df, names, 7, "id", ["id"], "y", cell_rows=60, block_rows=100).collect()}
    for i in range(600):
        assert math.isclose(votes[i], y[np.lexsort((np.arange(600), ((x - x[i]) ** 2).sum(axis=1)))[:7]].mean())
    plan = K.knn_classify(df, df, names, 7, "id", ["id"], "y", cell_rows=60)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "FlatMapGroups" not in plan


def test_rows_that_come_twice_are_predicted_without_their_own_fold(spark):
    from tessera.operators import bagging as B
    rng = np.random.default_rng(14)
    x, ids = rng.normal(size=(60, 2)), np.arange(60)
    x, ids, fold = np.concatenate([x, x[:20]]), np.concatenate([ids, ids[:20]]), np.concatenate([np.arange(60) % 3, (np.arange(20) + 1) % 3])
    y = x.sum(axis=1) + np.sin(7 * ids)
    grid = B.BagGrid(("x", "y"), (3,), (0.5,), (1.0,), (2,), seed=5)
    df = spark.createDataFrame([(int(i), *map(float, p), float(t), int(f)) for i, p, t, f in zip(ids, x, y, fold)], "id long, x double, y double, label double, fold int")
    sse = np.zeros(3)
    for q in range(80):
        count = B.times_drawn(B.draws(ids, np.arange(3), 5), 0.5) * (fold != fold[q])[:, None]
        order = np.lexsort((ids, ((x - x[q]) ** 2).sum(axis=1)))
        means = [np.mean([y[i] for i in order for _ in range(count[i, e])][:2]) for e in range(3)]
        sse[fold[q]] += (y[q] - np.mean(means)) ** 2
    got = {r["g"]: (r["sse"], r["n"]) for r in B.squared_errors(df, grid, "id", "label", "fold", depth=70).collect()}
    assert all(math.isclose(got[f][0], sse[f], rel_tol=1e-9) and got[f][1] == (fold == f).sum() for f in range(3))
