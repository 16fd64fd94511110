"""Classifiers of single series, all series, targets and folds in one shuffle.

Rows of a series meet in one task, which fits a small model for each target and
fold and returns answers as rows. At the daily grain a series has one row per
calendar day, so no group grows with the raw data, and thousands of series are as
many independent pieces of one stage. Learners are deterministic: a series gets
the same answers alone and among others.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skygrade.models.kernel import KernelMap, fit_flat, hinge, scale_gamma
from skygrade.models.neighbours import by_series

# Weight of the squared coefficients against the summed loss of all rows, and of misses against them.
PENALTY = 1.0
COST = 1.0


def softmax(scores):
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


class Logistic:
    """Logistic regression at its optimum, by Newton steps; more than two classes share one softmax.

    The intercepts are free. Newton steps do not depend on the scale of the
    inputs, so they need no standardising.
    """

    def __init__(self, penalty=PENALTY, steps=100, tolerance=1e-8):
        self.penalty, self.steps, self.tolerance = penalty, steps, tolerance

    def scores(self, w, x):
        return np.column_stack([np.zeros(len(x)), x @ w.T]) if self.two else x @ w.T

    def loss(self, w, x, rows, y):
        """The penalised loss, and the probability of each class."""
        scores = self.scores(w, x)
        top = scores.max(axis=1, keepdims=True)
        shares = np.exp(scores - top)
        total = shares.sum(axis=1, keepdims=True)
        return (np.log(total) + top).sum() - scores[rows, y].sum() + self.penalty * (w[:, 1:] ** 2).sum() / 2, shares / total

    @staticmethod
    def prepared(x):
        """Centre, directions and coordinates of the rows: with fewer rows than inputs the coefficients lie in the rows' span."""
        centre = x.mean(axis=0)
        if len(x) > x.shape[1]:
            return centre, np.eye(x.shape[1]), x - centre
        u, size, axes = np.linalg.svd(x - centre, full_matrices=False)
        return centre, axes, u * size

    def fit(self, x, y, classes):
        return self.fit_prepared(self.prepared(x), y, classes)

    def fit_prepared(self, given, y, classes):
        self.two = classes == 2
        self.centre, axes, x = given
        x = np.column_stack([np.ones(len(x)), x])
        rows, width = np.arange(len(x)), x.shape[1]
        free = 1 if self.two else classes
        w = np.zeros((free, width))
        ridge = np.tile(np.r_[0.0, np.full(width - 1, self.penalty)], free)
        onehot = np.eye(classes)[y][:, classes - free :]
        now, p = self.loss(w, x, rows, y)
        own, starts = np.arange(free), np.arange(0, w.size, width)
        for _ in range(self.steps):
            p = p[:, classes - free :]
            slope = ((p - onehot).T @ x).ravel() + ridge * w.ravel()
            if np.abs(slope).max() <= self.tolerance * len(x):
                break
            weighted = (p[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            bend = -weighted.T @ weighted
            bend.ravel()[:: len(bend) + 1] += ridge
            bend.reshape(free, width, free, width)[own, :, own, :] += x.T @ (p.T[:, :, None] * x)
            step = self.newton(bend, slope, starts).reshape(w.shape)
            size = 1.0
            while size > 1e-8:
                then, p = self.loss(w - size * step, x, rows, y)
                if then <= now - 1e-4 * size * (slope @ step.ravel()):
                    break
                size /= 2
            if size <= 1e-8:
                break
            w, now = w - size * step, then
        self.w = np.column_stack([w[:, 0], w[:, 1:] @ axes])
        return self

    def newton(self, bend, slope, intercepts):
        """The step; adding one number to the intercepts of all classes changes nothing, so the step has no part of that."""
        if not self.two:
            bend[np.ix_(intercepts, intercepts)] += 1.0
        try:
            step = np.linalg.solve(bend, slope)
        except np.linalg.LinAlgError:
            step = np.full(len(slope), np.nan)
        return step if np.isfinite(step).all() else np.linalg.lstsq(bend, slope, rcond=1e-13)[0]

    def predict(self, x):
        return self.scores(self.w, np.column_stack([np.ones(len(x)), x - self.centre])).argmax(axis=1)


class Tree:
    """Classification tree of any depth: the split that lowers the Gini impurity most, the first of equal ones, until leaves are pure."""

    @staticmethod
    def prepared(x):
        return x

    def fit(self, x, y, classes):
        return self.fit_prepared(x, y, classes)

    def fit_prepared(self, x, y, classes):
        self.nodes, todo = [], [(np.arange(len(x)), None, None)]
        onehot = np.eye(classes)
        while todo:
            rows, parent, side = todo.pop()
            if parent is not None:
                self.nodes[parent][side] = len(self.nodes)
            counts = np.bincount(y[rows], minlength=classes)
            split = None if (counts > 0).sum() < 2 else self.split(x[rows], onehot[y[rows]], counts)
            self.nodes.append([*(split or (-1, 0.0)), 0, 0, int(counts.argmax())])
            if split:
                left = x[rows, split[0]] <= split[1]
                here = len(self.nodes) - 1
                todo += [(rows[~left], here, 3), (rows[left], here, 2)]
        return self

    @staticmethod
    def split(x, onehot, counts):
        order = np.argsort(x, axis=0, kind="stable")
        values = np.take_along_axis(x, order, axis=0)
        left = np.cumsum(onehot[order[:-1]], axis=0)  # rows before a cut, by feature and class
        n = np.arange(1, len(x), dtype=float)[:, None]
        gain = (left**2).sum(axis=2) / n + ((counts - left) ** 2).sum(axis=2) / (len(x) - n)
        gain[values[1:] <= values[:-1]] = -1.0
        best = gain.max()
        if best < 0:
            return None
        feature, at = np.argwhere(gain.T >= best - 1e-12 * abs(best))[0]
        low, high = values[at, feature], values[at + 1, feature]
        middle = low + (high - low) / 2
        return int(feature), float(low if middle >= high else middle)

    def predict(self, x):
        at = np.zeros(len(x), int)
        feature, cut, left, right, answer = (np.array(c) for c in zip(*self.nodes))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node]).astype(int)
        return answer[at]


class RadialMachine:
    """Support vector machine with a radial kernel, by landmarks: one machine for each pair of classes, then a vote.

    Equal votes go to the smaller class. Inputs enter as they are unless ``scaled``,
    so those with large numbers decide about distances.
    """

    def __init__(self, cost=COST, scaled=False):
        self.cost, self.scaled = cost, scaled

    def prepared(self, x):
        """The spread of the inputs and the kernel map of the rows."""
        spread = x.std(axis=0)
        spread = np.where(spread > 0, spread, 1.0) if self.scaled else 1.0
        x = x / spread
        return spread, KernelMap(x, scale_gamma(x))

    def fit(self, x, y, classes):
        return self.fit_prepared(self.prepared(x), y, classes)

    def fit_prepared(self, given, y, classes):
        (self.spread, self.map), self.classes, self.machines = given, classes, []
        for a in range(classes):
            for b in range(a + 1, classes):
                rows = np.flatnonzero((y == a) | (y == b))
                sign = np.where(y[rows] == a, 1.0, -1.0)
                self.machines.append((a, b, *fit_flat(self.map.rows[rows], hinge(sign), self.cost)))
        return self

    def predict(self, x):
        z, votes = self.map.map(x / self.spread), np.zeros((len(x), self.classes), int)
        for a, b, w, shift in self.machines:
            np.add.at(votes, (np.arange(len(x)), np.where(z @ w + shift >= 0, a, b)), 1)
        return votes.argmax(axis=1)


LEARNERS = {"LogisticRegression": Logistic, "DecisionTree": Tree, "SVM": RadialMachine, "ScaledSVM": partial(RadialMachine, scaled=True)}


def answers_of(table: pa.Table, k, o, targets, width, learner) -> pa.Table:
    """Answers for the test rows of every fold of one series."""
    table = table.sort_by("_rn")
    rn, fold, start = (table.column(c).to_numpy() for c in ("_rn", "fold", "start"))
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    names = [*k, *o, "target", "fold", "y", "p"]
    given, ints = table.select([*k, *o]), lambda v: pa.array(v, pa.int32())
    parts, ready = [], {}  # targets with the same training rows share what only depends on their inputs
    for target in targets:
        label = table.column(target).to_numpy().astype(float)
        known = ~np.isnan(label)
        for i in np.unique(fold[~np.isnan(fold.astype(float))]):
            test = np.flatnonzero((fold == i) & known)
            train = np.flatnonzero((rn < start[test[0]]) & known) if len(test) else test
            classes, y = np.unique(label[train].astype(int), return_inverse=True)
            if len(classes) < 2:
                continue
            model, rows = LEARNERS[learner](), train.tobytes()
            if rows not in ready:
                ready[rows] = model.prepared(x[train])
            p = classes[model.fit_prepared(ready[rows], y, len(classes)).predict(x[test])]
            columns = [*given.take(pa.array(test)).columns, pa.array([target] * len(test))]
            columns += [ints(np.full(len(test), i, int)), ints(label[test].astype(int)), ints(p)]
            parts.append(pa.Table.from_arrays(columns, names=names))
    none = [*given.slice(0, 0).columns, pa.array([], pa.string()), *[ints([])] * 3]
    return pa.concat_tables(parts) if parts else pa.Table.from_arrays(none, names=names)


def cls_by_site(frame: DataFrame, features, targets, learner, k=("site",), o=("dt",), n_folds=5) -> DataFrame:
    """(series, order, target, fold, y, p) for the test rows of every fold with two or more classes.

    ``learner`` is a name in LEARNERS. Rows without a label are neither learnt nor
    asked; inputs must be complete. Series are dealt to as many tasks as the session
    shuffles into: adaptive execution would put many short series, whose fits take
    long, into one task.
    """
    fit = lambda table: answers_of(table, k, o, targets, len(features), learner)
    return by_series(frame, features, targets, k, o, n_folds, fit, ((*k, *o), "target string, fold int, y int, p int"))
