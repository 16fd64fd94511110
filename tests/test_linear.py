"""Linear classifiers over all sites: their optimum against MLlib's and by its definition, few jobs for all targets."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrade.models import linear as L
from skygrade.models import training
from skygrade.models.estimators import CLASSIFIERS, inputs, named

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def parts(spark):
    """Forty sites, each with a shift of its own; the last one has test rows alone."""
    rng = np.random.default_rng(4)
    rows = []
    for s in range(41):
        shift = rng.normal()
        for i in range(20):
            x, z = rng.normal(), rng.normal()
            label = 3 + int(x + shift > 0) + int(z > 0.7)
            rows.append((f"S{s}", DAY + dt.timedelta(days=i), x, z, label, 1 + int(x > 0), 5, "test" if i >= 15 or s == 40 else "train"))
    df = spark.createDataFrame(rows, "site string, dt date, x double, z double, a int, b int, flat int, role string")
    return df.where("role = 'train'").drop("role"), df.where("role = 'test'").drop("role")


@pytest.mark.parametrize("target", ["a", "b"])
def test_logistic_equals_the_learner_of_mllib(parts, target):
    train, test = parts
    got = training.fit_classifier(train, test, target, "LogisticRegression", ["x", "z"], {})
    flow = inputs(train, ["x", "z"], True)
    seen = sorted(r[0] for r in train.select(target).distinct().collect())
    label = (F.array_position(F.array(*[F.lit(c) for c in seen]), F.col(target)) - 1).cast("double")
    learner = named(CLASSIFIERS["LogisticRegression"]({"max_iter": 2000}, {"rows": train.count()}).setTol(1e-12))
    theirs = learner.fit(flow.transform(train.withColumn("label", label))).transform(flow.transform(test))
    want = {(r.site, r.dt): seen[int(r.p)] for r in theirs.collect()}
    found = {(r.site, r.dt): r.p for r in got.collect()}
    assert found.keys() == want.keys() and sum(found[k] != want[k] for k in want) <= 1


@pytest.mark.parametrize("model", ["LogisticRegression", "SVM"])
def test_all_targets_take_few_jobs_and_beat_the_commonest_class(spark, parts, model):
    spark.sparkContext.setJobGroup(model, model)
    pred = training.fit_targets(training.fit_classifier, *parts, ["a", "b", "flat"], model, ["x", "z"], {}).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(model))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150 and {r.target for r in pred} == {"a", "b"}
    for target in "ab":
        y, p = (np.array([r[c] for r in pred if r.target == target]) for c in "yp")
        assert len(y) == 220 and (y == p).sum() > np.bincount(y).max()


@pytest.mark.parametrize("model", [L.Softmax(0, (0, 1)), L.Softmax(0, (0, 1, 2)), L.Hinge(0, 1)])
def test_weights_are_best_for_all_and_for_each_site(model):
    """No small change of the shared weights or of those of the sites lowers the whole loss; packs add up."""
    rng = np.random.default_rng(6)
    site = np.sort(rng.integers(0, 9, 150))
    x, y = np.column_stack([np.ones(150), rng.normal(size=(150, 3))]), rng.integers(0, 3 if model == L.Softmax(0, (0, 1, 2)) else 2, 150).astype(float)
    ridge, state, width = np.r_[0.0, np.ones(3)], L.State(np.zeros((model.outputs, 4)), np.zeros((model.outputs, 4))), model.widths[-1]
    pack = lambda rows: L.own_rows((site[rows], x[rows], y[rows, None]), model, True)
    for _ in range(300):
        total = 0
        for rows in (np.flatnonzero(site < 4), np.flatnonzero(site >= 4)):
            own, label, at, starts, _ = pack(rows)
            total = total + L.sums_of_pack(model, state.w, state.step, own, label, at, starts, model.widths[state.level])
        k = 1 + len(model.smaller)
        if not L.newton(model, state, total[:k], total[k : k + state.w.size].reshape(state.w.shape), total[k + state.w.size :], ridge):
            break
    else:
        raise AssertionError("no end")
    own, label, at, starts, _ = pack(np.arange(150))
    label = model.labels(label)
    s = L.site_weights(model, own @ state.w.T, label, at, starts, width)
    loss = lambda w, s: model.losses(own @ w.T + s[at], label, width)[0].sum() + (ridge * w * w).sum() / 2 + (s * s).sum() / 2
    best = loss(state.w, s)
    for _ in range(200):
        assert best <= loss(state.w + rng.normal(size=state.w.shape) * 0.003, s + rng.normal(size=s.shape) * 0.003) + 1e-4
