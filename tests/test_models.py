import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrade.models import estimators, training
from skygrade.models.autoregressive import ar_fit, forecast_recursive, forecast_status, last_values
from skygrade.models.bayes import cls_naive_bayes
from skygrade.models.neighbours import cls_knn
from skygrade.operators import metrics as M
from skygrade.operators.folds import split_chrono
from skygrade.operators.search import grid_search
from skygrade.session import materialise

DAY = dt.date(2024, 1, 1)


def frame(spark, n=40, sites=("A", "B"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for site in sites:
        for i in range(n):
            x, z = rng.normal(size=2)
            label = 3 + int(x > 0) + int(z > 0.5)
            rows.append((site, DAY + dt.timedelta(days=i), float(x), float(z), float(2 * x - z), label, 5))
    return spark.createDataFrame(rows, "site string, dt date, x double, z double, target double, label int, flat int")


def scores(spark, rows):
    return spark.createDataFrame(rows, "y double, p double")


def value(df):
    return df.first()["value"]


def test_metrics(spark):
    pred = scores(spark, [(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)])
    assert value(M.m_mae(pred, [])) == 1.0
    assert value(M.m_rmse(pred, [])) == pytest.approx(math.sqrt(5 / 3))
    assert value(M.m_r2(pred, [])) == pytest.approx(1 - 5 / 8)
    assert value(M.m_r2(scores(spark, [(2.0, 1.0), (2.0, 2.0)]), [])) == 0.0
    assert value(M.m_r2(scores(spark, [(2.0, 2.0), (2.0, 2.0)]), [])) == 1.0


def test_weighted_f1(spark):
    pred = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2)], "y int, p int")
    assert value(M.m_f1_weighted(pred, [])) == pytest.approx((3 * 0.8 + 2 / 3) / 4)
    assert value(M.m_accuracy(pred, [])) == 0.75
    assert value(M.m_f1_weighted(spark.createDataFrame([(1, 2)], "y int, p int"), [])) == 0.0


def test_first_best_candidate_wins(spark):
    rows = [("t", "m", "a", 0, f, 2.0) for f in (0, 1)] + [("t", "m", "b", 1, f, v) for f, v in ((0, 1.0), (1, 2.0))]
    rows += [("t", "m", "c", 2, f, v) for f, v in ((0, 2.0), (1, 1.0))]
    assert grid_search(spark.createDataFrame(rows, training.SCORE_FIELDS)).first().params == "b"


def expanding(n, k):
    size = n // (k + 1)
    return [(range(n - (k - i) * size), range(n - (k - i) * size, n - (k - i - 1) * size)) for i in range(k)]


def by_site(df):
    return {s: g.sort_values("dt").reset_index(drop=True) for s, g in df.toPandas().groupby("site")}


def answers(df, target="label"):
    return {(r.site, r.dt, r.fold): (r.y, r.p) for r in df.where(F.col("target") == target).collect()}


@pytest.mark.parametrize("block_rows", [7, 256])
def test_neighbours_equal_brute_force(spark, block_rows):
    df = frame(spark)
    got = cls_knn(df, ["x", "z"], ["label", "flat"], block_rows=block_rows)
    assert got.where("target = 'flat'").count() == 0
    got, want = answers(got), {}
    for site, g in by_site(df).items():
        x, y = g[["x", "z"]].to_numpy(), g.label.to_numpy()
        for fold, (train, test) in enumerate(expanding(len(g), 5)):
            if len(set(y[list(train)])) < 2:
                continue
            for t in test:
                gaps = ((x[list(train)] - x[t]) ** 2).sum(axis=1)
                votes = list(y[np.argsort(gaps, kind="stable")[:5]])
                want[site, g.dt[t], fold] = (y[t], min(set(votes), key=lambda c: (-votes.count(c), c)))
    assert got == want


def test_naive_bayes_equals_brute_force(spark):
    df = frame(spark)
    got = cls_naive_bayes(df, ["x", "z"], ["label", "flat"])
    assert got.where("target = 'flat'").count() == 0
    got, want = answers(got), {}
    for site, g in by_site(df).items():
        x, y = g[["x", "z"]].to_numpy(), g.label.to_numpy()
        for fold, (train, test) in enumerate(expanding(len(g), 5)):
            xt, yt = x[list(train)], y[list(train)]
            if len(set(yt)) < 2:
                continue
            extra = 1e-9 * xt.var(axis=0).max()
            for t in test:
                rank = {}
                for c in sorted(set(yt)):
                    part = xt[yt == c]
                    var = part.var(axis=0) + extra
                    rank[c] = math.log(len(part) / len(yt)) - 0.5 * (np.log(2 * np.pi * var) + (x[t] - part.mean(axis=0)) ** 2 / var).sum()
                want[site, g.dt[t], fold] = (y[t], max(rank, key=rank.get))
    assert got == want


def test_autoregression_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    values = {s: rng.normal(size=60).cumsum() for s in "AB"}
    df = spark.createDataFrame([(s, DAY + dt.timedelta(days=i), float(v)) for s, vs in values.items() for i, v in enumerate(vs)], "site string, dt date, m double")
    for row in ar_fit(df, ["site"], "m", ridge=0.0).collect():
        v = values[row.site]
        lags = np.array([[1.0, *v[i - 7 : i][::-1]] for i in range(7, 60)])
        assert row.n_rows == 53
        assert row.coefficients == pytest.approx(np.linalg.lstsq(lags, v[7:], rcond=None)[0], abs=1e-6)


def history(spark, values):
    return spark.createDataFrame([("A", DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)], "site string, dt date, m double")


def test_recursion(spark):
    last = last_values(history(spark, [1.0, 9.0, 2.0, 5.0, 1.0, 4.0, 7.0, 3.0]), ["site"], "m")
    same = last.select("site", F.array(*[F.lit(float(i == 1)) for i in range(8)]).alias("coefficients"))
    out = forecast_recursive(same, last).orderBy("step").collect()
    assert [(r.step, r.p, r.dt) for r in out] == [(i, 3.0, DAY + dt.timedelta(days=7 + i)) for i in range(1, 8)]
    oldest = last.select("site", F.array(*[F.lit(float(i == 7)) for i in range(8)]).alias("coefficients"))
    assert [r.p for r in forecast_recursive(oldest, last).orderBy("step").collect()] == [9.0, 2.0, 5.0, 1.0, 4.0, 7.0, 3.0]


def test_short_series_has_no_forecast(spark):
    last = last_values(history(spark, [1.0, 2.0]), ["site"], "m")
    same = last.select("site", F.array(*[F.lit(1.0)] * 8).alias("coefficients"))
    assert forecast_recursive(same, last).count() == 0
    assert forecast_status(last).first().status == "short"


def test_candidates_cover_the_grid():
    grid = estimators.candidates(estimators.GRIDS["RandomForest"])
    assert len(grid) == 6 and grid[0] == {"max_depth": 5, "n_estimators": 100}
    assert len(estimators.candidates(estimators.GRIDS["GradientBoosting"])) == 8


def test_regression_search_beats_the_mean_and_keeps_failures(spark, monkeypatch):
    def broken(params, info):
        raise ValueError("no such model")

    monkeypatch.setitem(estimators.REGRESSORS, "Broken", broken)
    split = materialise(split_chrono(frame(spark, 60), ["site"], ["dt"]))
    grids = {"RandomForest": [{"n_estimators": 10, "max_depth": d} for d in (1, 5)], "Broken": [{}]}
    pred, chosen, failed = training.train_regressors(split, ["target"], grids, ["x", "z"], expanding=False)
    rows = {r.model: r for r in training.regression_results(spark, pred, chosen, failed).collect()}
    assert rows["RandomForest"].status == "ok" and 0 < rows["RandomForest"].r2 <= 1
    assert '"max_depth": 5' in rows["RandomForest"].params
    assert rows["Broken"].status == "failed: ValueError: no such model" and rows["Broken"].mae is None


def test_classification_skips_single_class_targets(spark):
    df = materialise(frame(spark, 36))
    pred, failed = training.cross_validate(df, ["label", "flat"], {"DecisionTree": {"max_depth": 4}}, ["x", "z"], n=3)
    rows = {r.target: r for r in training.classification_results(spark, pred, failed).collect()}
    assert rows["label"].status == "ok" and rows["label"].accuracy > 0.5
    assert rows["flat"].status == "skipped: one class" and rows["flat"].f1 is None
