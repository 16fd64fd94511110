"""Models of single series, many at once: learners against plain re-computations, series against themselves."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skygrade.models import by_site as B
from skygrade.models import kernel as K
from skygrade.models import neighbours as N
from skygrade.models.autoregressive import ar_fit_tube, ar_predict_tube, forecast_tube, last_values
from skygrade.models.estimators import CLASSIFIERS, inputs, named
from skygrade.operators.folds import fold_expanding, fold_skip_single_class

DAY = dt.date(2024, 1, 1)
FEATURES = ["x", "z", "w"]


def frame(spark, sites, n=36, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sites):
        for i in range(n):
            x, z, w = (float(v) for v in np.round(rng.normal(size=3) * (1, 1, 40), 2))
            rows.append((f"S{s}", DAY + dt.timedelta(days=i), x, z, w, 3 + int(x > 0) + int(z > 0.6), 1 + int(w > s), 4))
    return spark.createDataFrame(rows, "site string, dt date, x double, z double, w double, a int, b int, flat int")


def bag(df):
    return sorted(map(tuple, df.select("site", "dt", "target", "fold", "y", "p").collect()))


@pytest.mark.parametrize("learner", ["LogisticRegression", "DecisionTree", "SVM"])
def test_three_hundred_series_in_one_job_equal_single_ones(spark, learner):
    many = frame(spark, 300, 24)
    spark.sparkContext.setJobGroup(learner, learner)
    rows = bag(B.cls_by_site(many, FEATURES, ["a", "b"], learner))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(learner))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3 and len({r[0] for r in rows}) == 300  # two shuffles and the result
    for site in ("S0", "S17", "S299"):
        alone = bag(B.cls_by_site(many.where(F.col("site") == site), FEATURES, ["a", "b"], learner))
        assert alone == [r for r in rows if r[0] == site]


def test_rows_are_those_of_the_folds_with_two_classes(spark):
    df = frame(spark, 3, 36)
    got = B.cls_by_site(df, FEATURES, ["a", "flat"], "DecisionTree")
    folds = fold_skip_single_class(fold_expanding(df, ["site"], ["dt"], 5), "a").where("role = 'test'")
    want = sorted((r.site, r.dt, r.fold, r.a) for r in folds.collect())
    assert sorted((r.site, r.dt, r.fold, r.y) for r in got.collect()) == want
    assert {r.target for r in got.collect()} == {"a"}


def test_rows_without_a_label_are_left_out(spark):
    df = frame(spark, 1, 36).withColumn("a", F.when(F.dayofmonth("dt") % 4 > 0, F.col("a")))
    rows = B.cls_by_site(df, FEATURES, ["a"], "DecisionTree").collect()
    assert rows and all(r.dt.day % 4 for r in rows)
    assert B.cls_by_site(df.limit(0), FEATURES, ["a"], "DecisionTree").collect() == []


def data(n=120, classes=3, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * (1, 30, 1, 0.1)
    y = np.clip((x[:, 0] + x[:, 1] / 30 > 0).astype(int) + (x[:, 2] > 0.8), 0, classes - 1)
    return x, y


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_is_at_its_optimum_and_equals_the_pooled_learner(spark, classes):
    x, y = data(classes=classes)
    own = B.Logistic().fit(x, y, classes)
    full = np.column_stack([np.ones(len(x)), x - own.centre])
    p = B.softmax(own.scores(own.w, full))[:, classes - len(own.w) :]
    slope = (p - np.eye(classes)[y][:, classes - len(own.w) :]).T @ full
    slope[:, 1:] += own.w[:, 1:]
    assert np.abs(slope).max() < 1e-4
    rows = [("S", *map(float, r), float(c)) for r, c in zip(x, y)]
    df = spark.createDataFrame(rows, "site string, a double, b double, c double, d double, label double")
    flow = inputs(df, list("abcd"), False)
    fitted = named(CLASSIFIERS["LogisticRegression"]({"max_iter": 2000}, {"rows": len(x)}).setTol(1e-10)).fit(flow.transform(df))
    theirs = fitted.coefficientMatrix.toArray()
    assert np.allclose(theirs, own.w[:, 1:], atol=2e-3)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_of_few_rows_solves_small_systems(monkeypatch, classes):
    """With fewer rows than inputs the systems are as large as the rows, and the optimum is the same."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(12, 40)) * np.logspace(0, 2, 40), np.arange(12) % classes
    sizes, solve, lstsq = [], np.linalg.solve, np.linalg.lstsq
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: sizes.append(len(a)) or solve(a, b))
    monkeypatch.setattr(np.linalg, "lstsq", lambda a, b, rcond=None: sizes.append(len(a)) or lstsq(a, b, rcond=rcond))
    own = B.Logistic().fit(x, y, classes)
    assert sizes and max(sizes) <= classes * (len(x) + 1)
    full = np.column_stack([np.ones(len(x)), x - own.centre])
    p = B.softmax(own.scores(own.w, full))[:, classes - len(own.w) :]
    slope = (p - np.eye(classes)[y][:, classes - len(own.w) :]).T @ full
    slope[:, 1:] += own.w[:, 1:]
    assert np.abs(slope).max() < 1e-5


def test_targets_with_the_same_rows_share_their_kernel_map(spark, monkeypatch):
    made, plain = [], B.KernelMap
    monkeypatch.setattr(B, "KernelMap", lambda *a: made.append(1) or plain(*a))
    n, rng = 36, np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    fold = [(i - 6) // 6 if i >= 6 else None for i in range(n)]
    start = [None if f is None else 6 + 6 * f for f in fold]
    table = pa.table({"site": ["S"] * n, "_rn": np.arange(n), "fold": pa.array(fold, pa.int32()), "start": pa.array(start, pa.int32()), "x": pa.array(list(x)), "a": np.arange(n) % 2, "b": np.arange(n) % 3})
    got = B.answers_of(table, ("site",), (), ["a", "b"], 2, "SVM")
    assert len(made) == 5 and got.num_rows == 60


@pytest.mark.parametrize("seed", range(4))
def test_machine_takes_few_steps_to_its_optimum(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    z, sign = rng.normal(size=(25, 12)), np.where(rng.random(25) < 0.4, 1.0, -1.0)
    steps, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: steps.append(1) or solve(a, b))
    w, shift = K.fit_flat(z, K.hinge(sign), 1.0)
    assert len(steps) <= 60
    loss = lambda w, shift: w @ w / 2 + np.maximum(1 - sign * (z @ w + shift), 0).sum()
    for _ in range(200):
        assert loss(w, shift) <= loss(w + rng.normal(size=12) * 0.01, shift + rng.normal() * 0.01) + 25e-5


def plain_tree(x, y, asked):
    """The tree by its definition, split by split."""
    gini = lambda c: 1 - ((np.bincount(c) / len(c)) ** 2).sum()
    if len(set(y)) == 1:
        return np.full(len(asked), y[0])
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= low
            after = (left.sum() * gini(y[left]) + (~left).sum() * gini(y[~left])) / len(y)
            if best is None or after < best[0] - 1e-12:
                best = (after, f, (low + high) / 2)
    if best is None:
        return np.full(len(asked), np.bincount(y).argmax())
    _, f, cut = best
    left, out = x[:, f] <= cut, np.empty(len(asked), int)
    side = asked[:, f] <= cut
    out[side], out[~side] = plain_tree(x[left], y[left], asked[side]), plain_tree(x[~left], y[~left], asked[~side])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_its_definition(seed):
    rng = np.random.default_rng(seed)
    x, y = np.round(rng.normal(size=(60, 3)), 1), rng.integers(0, 3, 60)
    x[10:14] = x[10]  # equal rows of several classes
    asked = rng.normal(size=(40, 3))
    own = B.Tree().fit(x, y, 3)
    assert (own.predict(asked) == plain_tree(x, y, asked)).all() and (own.predict(x) == plain_tree(x, y, x)).all()


def ring(n=300):
    rng = np.random.default_rng(0)
    r = np.r_[rng.uniform(0, 1, n), rng.uniform(1.5, 2.5, n)]
    a = rng.uniform(0, 2 * np.pi, 2 * n)
    return np.c_[r * np.cos(a), r * np.sin(a)], np.r_[np.zeros(n, int), np.ones(n, int)]


def test_radial_machine_separates_a_ring_that_a_line_cannot():
    x, y = ring()
    assert (B.RadialMachine().fit(x, y, 2).predict(x) == y).all()
    assert (B.Logistic().fit(x, y, 2).predict(x) == y).mean() < 0.7


def test_landmarks_approximate_the_kernel():
    x, _ = ring()
    gamma, errors = K.scale_gamma(x), []
    for most in (5, 20, 128):
        known = K.KernelMap(x, gamma, most)
        errors.append(np.abs(known.rows @ known.rows.T - K.radial(x, x, gamma)).max())
        assert errors[-1] <= known.error + 1e-12 and np.allclose(known.map(x), known.rows, atol=1e-6)
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-6


def dual_bound(k, y, cost, epsilon, f, width=1e-5):
    """A lower bound of the least possible objective, from the multipliers that the errors imply."""
    beta = np.clip((np.abs(y - f) - epsilon) / width, 0, 1) * cost * np.sign(y - f)
    beta -= beta.mean()
    return y @ beta - beta @ k @ beta / 2 - epsilon * np.abs(beta).sum()


def test_tube_regression_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.uniform(1, 5, (90, 7))
    y = x[:, 0] / 2 + np.sin(x[:, 1]) + rng.normal(0, 0.3, 90)
    known = K.KernelMap(x, 0.01)
    w, shift = K.fit_flat(known.rows, K.tube(y, 0.1), 10.0)
    f = known.rows @ w + shift
    value = w @ w / 2 + 10 * np.maximum(np.abs(y - f) - 0.1, 0).sum()
    bound = dual_bound(K.radial(x, x, 0.01), y, 10.0, 0.1, f)
    assert bound <= value + 1e-6 and value - bound < 2e-3 * value


def test_errors_within_the_tube_cost_nothing(spark):
    rows = [("flat", DAY + dt.timedelta(days=i), 3 + 0.09 * (-1) ** i) for i in range(40)]
    rows += [("steps", DAY + dt.timedelta(days=i), float(1 + i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "site string, dt date, v double")
    fitted = ar_fit_tube(df, ["site"], "v")
    got = {r.site: r for r in fitted.collect()}
    assert got["flat"].n_rows == got["flat"].n_inside == 33 and max(map(abs, got["flat"].weights)) < 1e-5
    assert got["steps"].n_inside >= 30 and max(map(abs, got["steps"].weights)) > 1
    pred = ar_predict_tube(df, fitted, ["site"], "v").collect()
    assert len(pred) == 66 and max(abs(r.y - r.p) for r in pred) < 0.11
    ahead = forecast_tube(fitted, last_values(df, ["site"], "v")).collect()
    assert [round(r.p) for r in sorted(ahead, key=lambda r: r.dt) if r.site == "steps"] == [1, 2, 3, 4, 1, 2, 3]
    assert min(r.dt for r in ahead) == DAY + dt.timedelta(days=40)


def test_neighbours_are_found_without_comparing_half_of_the_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [
        ("S", DAY + dt.timedelta(days=i), *map(float, rng.normal(size=3) * (100, 10, 1)), int(rng.integers(1, 4)))
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "site string, dt date, x double, z double, w double, a int")
    work = N.knn_work(df, FEATURES, ["a"]).first()
    assert 0 < work.n_compared < work.n_pairs / 2
    pruned = bag(N.cls_knn(df, FEATURES, ["a"]))
    assert pruned == bag(N.cls_knn(df, FEATURES, ["a"], block_rows=10_000)) and len(pruned) == 1250


@pytest.mark.parametrize("size", [2, 7, 64])
def test_nearest_rows_equal_a_full_search(size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, 4, (90, 2)).astype(float)  # many equal distances
    known, asked = np.arange(60), np.arange(60, 90)
    _, found, compared = N.nearest(x, asked, known, 5, size)
    gaps = ((x[asked][:, None] - x[known][None]) ** 2).sum(axis=2)
    assert (found == np.argsort(gaps, axis=1, kind="stable")[:, :5]).all() and compared <= gaps.size
    few = N.nearest(x, asked, known[:3], 5, size)[1]
    assert (np.sort(few, axis=1)[:, :2] == -1).all()
